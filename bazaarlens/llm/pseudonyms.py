"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

Values are found by pattern and validated (a card number by its check digit, an address by its octets, a date by
the calendar). Each valid one is replaced by another valid value of the same format: a Feistel network over the
format's own range, keyed and unbroken, so two values never meet and the same value gets the same pseudonym in
every document. A value is cut into two parts a and b; rounds add a keyed hash of one part to the other, modulo
the other's range. Ranges need not be powers of two, so no value falls outside its format:

* card numbers: all digits but the last, which is the check digit again;
* phone numbers: the digits after the country code (after "+", or a leading 1) or, without one, all;
* IPv4 addresses: 16 + 16 bits;
* dates: the day within its century (36,525 = 75 * 487 or 36,524 = 92 * 397 days);
* social security numbers: area x (group, serial) in their valid ranges;
* e-mail names, and secrets after "token", "password", "secret" or "api key", to the end of their run: letters and digits, each
  moved within its class by a hash of the other half. Long secrets are moved in pieces of ``PIECE`` characters.

Everything is a Spark expression on one row: no shuffle, no Python. Separators, capitals and lengths stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.shared import fresh

ROUNDS = 10
PIECE = 512
# Steps after which a walk through dates has ended: each ends it with a chance of 3 in 5.
_WALK = 64
_POWERS = [10**n for n in range(19)]

_SECRET_HEAD = r"(?i:token|secret|password|passwd|api[_-]?key)[\x20]{0,4}[=:][\x20]{0,4}[\x22\x27]?"

# The patterns, in the order in which they are tried at a place. All are bounded or possessive.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,20}+",
    "secret": r"(?<![A-Za-z0-9])" + _SECRET_HEAD + r"[A-Za-z0-9_.+/=\x2D]{12,}+",
    "date": r"(?<![0-9])(?<![0-9][./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./-])[0-9]{2}\2[0-9]{4})(?![0-9])(?![./-][0-9])",
    "ip": r"(?<![0-9])(?<![0-9][.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])",
    "phone": r"(?<![0-9+])\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9](?:[\x20.-]?\(?[0-9]\)?){7,14}(?![0-9])|(?<![0-9])\([0-9]{3}\)[\x20]?[0-9]{3}[-.\x20][0-9]{4}(?![0-9])|(?<![0-9])(?<![0-9][-.])(?:1[-.\x20])?[0-9]{3}([-.\x20])[0-9]{3}\3[0-9]{4}(?![0-9])(?![-.][0-9])",
    "card": r"(?<![0-9])(?<![0-9][.,])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\4[0-9]{4}\4[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\5[0-9]{5})(?![0-9])(?![.,][0-9])",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """A number below 2^60 that depends on the key and all parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, a_range: Column, b: Column, b_range: Column) -> Column:
    """Struct (a, b): a permutation of the pairs below (a_range, b_range), one for each key, kind and range."""

    def step(at: Column, turn: Column) -> Column:
        new_a = F.pmod(at["a"] + _keyed(key, kind, turn, a_range, b_range, at["b"]), a_range)
        new_b = F.pmod(at["b"] + _keyed(key, kind, turn, a_range, b_range, at["a"]), b_range)
        even = turn % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(at["a"]).alias("a"), F.when(even, at["b"]).otherwise(new_b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p).cast("long") for p in _POWERS)), n + 1)


def _moved_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of digits (up to 36) as another one of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.length(digits))
    sizes = (half, F.length(digits) - half)
    moved = feistel(key, kind, _number(a), _power(sizes[0]), _number(b), _power(sizes[1]))
    return _let(moved, lambda m: F.concat(*(F.lpad(m[x].cast("string"), n, "0") for x, n in zip("ab", sizes, strict=True))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_over(value: Column, digits: Column, first: Column) -> Column:
    """``value`` with its digits from number ``first`` (0 on) replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(at: Column, c: Column) -> Column:
        new = F.when(at["n"] >= first, F.substring(digits, at["n"] - first + 1, F.lit(1))).otherwise(c)
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(at["out"], F.when(is_digit, new).otherwise(c)).alias("out"), (at["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(value, ""), start, step, lambda at: at["out"])


def _luhn(digits: Column) -> Column:
    """Check digit that a string of digits asks for."""

    def weighed(c: Column, k: Column) -> Column:
        d = c.cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda s, d: s + d)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _card(key: str, value: Column) -> Column:
    def with_digits(d: Column) -> Column:
        head = F.substring(d, F.lit(1), F.length(d) - 1)
        moved = _let(_moved_digits(key, "card", head), lambda m: _laid_over(value, F.concat(m, _luhn(m)), F.lit(0)))
        return F.when(_luhn(head) == F.substring(d, -1, 1), moved)

    return _let(_digits(value), with_digits)


def _phone(key: str, value: Column) -> Column:
    """The country code of an international number stays."""
    code = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})", 1))).when(value.rlike(r"^1[-.\x20]"), 1).otherwise(0)

    def with_digits(d: Column) -> Column:
        rest = F.substring(d, code + 1, F.length(d))
        return F.when(F.length(rest).between(7, 14) & (F.length(d) <= 15), _laid_over(value, _moved_digits(key, "phone", rest), code))

    return _let(_digits(value), with_digits)


def _ip(key: str, value: Column) -> Column:
    def with_octets(o: Column) -> Column:
        n = [o[i].cast("long") for i in range(4)]
        valid = F.forall(o, lambda x: x.cast("int") <= 255)
        side = F.lit(1 << 16).cast("long")
        moved = feistel(key, "ip", n[0] * 256 + n[1], side, n[2] * 256 + n[3], side)
        parts = lambda m: F.concat_ws(".", *(f.cast("string") for x in "ab" for f in (F.floor(m[x] / 256), m[x] % 256)))
        return F.when(valid, _let(moved, parts))

    return _let(F.split(value, r"\."), with_octets)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0 to 897
    serials = F.lit(9999).cast("long")
    moved = feistel(key, "ssn", place, F.lit(898).cast("long"), (group - 1) * serials + serial - 1, F.lit(99).cast("long") * serials)

    def written(m: Column) -> Column:
        back = F.when(m["a"] >= 665, m["a"] + 2).otherwise(m["a"] + 1)
        numbers = ((back, 3), (F.floor(m["b"] / serials) + 1, 2), (m["b"] % serials + 1, 4))
        return F.concat_ws("-", *(F.lpad(n.cast("long").cast("string"), w, "0") for n, w in numbers))

    return F.when(valid, _let(moved, written))


def _date(key: str, value: Column) -> Column:
    """Four-digit years from 1 on; of a date with the year last, the middle part is the month if it can be."""
    mark = F.regexp_extract(value, "[^0-9]", 0)
    parts = F.split(value, "[^0-9]")
    year_first = F.length(parts[0]) == 4
    day_first = ~year_first & (parts[1].cast("int") <= 12)
    year = F.when(year_first, parts[0]).otherwise(parts[2])
    month = F.when(year_first | day_first, parts[1]).otherwise(parts[0])
    day = F.when(year_first, parts[2]).when(day_first, parts[0]).otherwise(parts[1])
    found = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")

    def permuted(d: Column) -> Column:
        century = F.floor((F.year(d) - 1) / 100).cast("int")
        first = F.make_date(century * 100 + 1, F.lit(1), F.lit(1))
        leap = (century + 1) % 4 == 0  # its last year is a leap year
        a_range, b_range = (F.when(leap, x).otherwise(y).cast("long") for x, y in ((75, 92), (487, 397)))
        n = F.date_diff(d, first).cast("long")
        moved = feistel(key, "date", F.floor(n / b_range), a_range, n % b_range, b_range)
        return _let(moved, lambda m: F.date_add(first, (m["a"] * b_range + m["b"]).cast("int")))

    def walked(d: Column) -> Column:
        """Permuted until the day is above 12 again: a permutation of the dates with such a day."""
        again = lambda x, _: F.when(F.day(x) > 12, x).otherwise(permuted(x))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), permuted(d), again)

    def with_date(d: Column) -> Column:
        def written(x: Column) -> Column:
            y, mo, dd = (F.date_format(x, f) for f in ("yyyy", "MM", "dd"))
            last = F.when(day_first, F.concat_ws("-", dd, mo, y)).otherwise(F.concat_ws("-", mo, dd, y))
            return F.replace(F.when(year_first, F.concat_ws("-", y, mo, dd)).otherwise(last), F.lit("-"), mark)

        new = F.when(year_first | day_first, permuted(d)).otherwise(walked(d))
        return F.when(d.isNotNull() & (F.year(d) >= 1), _let(new, written))

    return _let(found, with_date)


def _moved_letters(key: str, kind: str, text: Column) -> Column:
    """A string with every ASCII letter and digit moved within its class; case and all else stay."""
    lower = F.lower(text)

    def place(c: Column) -> Column:
        return F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), F.ascii(c) - 48).otherwise(0)

    def size(c: Column) -> Column:
        return F.when(c.between("a", "z"), 26).when(c.between("0", "9"), 10).otherwise(1)

    def with_chars(cs: Column) -> Column:
        half = F.floor(F.size(cs) / 2).cast("int")
        lefts, rights = F.slice(cs, F.lit(1), half), F.slice(cs, half + 1, F.size(cs))

        def moved(mine: Column, letters: Column, other: Column, turn: Column) -> Column:
            def by(seen: Column) -> Column:
                return F.transform(mine, lambda x, i: F.pmod(x + _keyed(key, kind, turn, i, seen), size(F.get(letters, i))).cast("int"))

            return _let(F.array_join(other.cast("array<string>"), ","), by)

        def step(at: Column, turn: Column) -> Column:
            even = turn % 2 == 0
            return F.struct(
                F.when(even, moved(at["a"], lefts, at["b"], turn)).otherwise(at["a"]).alias("a"),
                F.when(even, at["b"]).otherwise(moved(at["b"], rights, at["a"], turn)).alias("b"),
            )

        start = F.struct(F.transform(lefts, place).alias("a"), F.transform(rights, place).alias("b"))
        whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda at: F.concat(at["a"], at["b"]))

        def char(n: Column, i: Column) -> Column:
            old = F.substring(text, i + 1, F.lit(1))
            letter = F.char(n + F.when(old.between("a", "z"), 97).when(old.between("A", "Z"), 65).otherwise(48))
            return F.when(old.rlike("[A-Za-z0-9]"), letter).otherwise(old)

        return F.array_join(F.transform(whole, char), "")

    return _let(F.split(lower, ""), with_chars)


def _email(key: str, value: Column) -> Column:
    return F.concat(_moved_letters(key, "email", F.substring_index(value, "@", 1)), F.lit("@"), F.substring_index(value, "@", -1))


def _secret(key: str, value: Column) -> Column:
    """The full stop of a sentence, or another mark at the end, takes no part. Each piece is cut out and moved once."""

    def with_start(start: Column) -> Column:
        def with_given(given: Column) -> Column:
            pieces = F.regexp_extract_all(given, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
            moved = F.array_join(F.transform(pieces, lambda piece: _moved_letters(key, "secret", piece)), "")
            whole = F.concat(F.substring(value, F.lit(1), start), moved, F.substring(value, start + F.length(given) + 1, F.length(value)))
            return F.when(F.length(given) > 0, whole)

        return _let(F.rtrim(F.substring(value, start + 1, F.length(value)), F.lit(".+/")), with_given)

    return _let(F.length(F.regexp_extract(value, f"^{_SECRET_HEAD}", 0)), with_start)


_MOVES = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def _found(key: str, value: Column) -> Column:
    """Struct (kind, new) of a matched string; both null if it is not valid."""
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(KINDS):
        is_kind = value.rlike(f"^(?:{_alone(name)})$")
        kind, new = F.when(is_kind, F.lit(name)).otherwise(kind), F.when(is_kind, _MOVES[name](key, value)).otherwise(new)
    return _let(F.struct(kind.alias("kind"), new.alias("new")), lambda f: F.struct(F.when(f["new"].isNotNull(), f["kind"]).alias("kind"), f["new"].alias("new")))


def _alone(name: str) -> str:
    """A kind's pattern with its group references counted from one."""
    pattern = PATTERNS[name]
    first = {"date": 1, "phone": 3, "card": 4}.get(name)
    for number in (1, 2, 3, 4, 5):
        if first:
            pattern = pattern.replace(f"\\{number}", f"\\{number - first + 1}") if number >= first else pattern
    return pattern


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str = "text", kinds_into: str = "pii") -> DataFrame:
    """``docs`` with the personal values in ``text`` replaced, and their kinds, in order, in ``kinds_into``.

    Strings that look like a value but are not valid stay as they are, as do texts without any. A null text stays
    null and has no kinds. The result depends on the key and the value alone, so repeated rows, ties and reruns agree.
    A table that has a column named ``kinds_into`` is refused; all other columns stay as they are, an empty table empty.
    """
    if kinds_into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {kinds_into} of its own: name another one in kinds_into")
    hold = fresh(docs, "_found")[0]
    value = F.col(f"`{text}`").cast("string")
    pieces = F.split(value, _ANY, -1)
    found = F.transform(F.regexp_extract_all(value, F.lit(_ANY), F.lit(0)), lambda v: F.struct(v.alias("old"), _found(key, v).alias("is")))
    empty = F.array().cast("array<struct<old:string,is:struct<kind:string,new:string>>>")
    marked = F.when(value.rlike(r"[0-9@=:]"), found).otherwise(empty)
    shown = F.transform(hold, lambda f: F.coalesce(f["is"]["new"], f["old"]))
    joined = F.array_join(F.zip_with(pieces, F.array_append(shown, F.lit("")), lambda p, v: F.concat(p, v)), "")
    changed = F.exists(hold, lambda f: f["is"]["new"].isNotNull())
    kinds = F.transform(F.filter(hold, lambda f: f["is"]["kind"].isNotNull()), lambda f: f["is"]["kind"])
    out = docs.withColumn(hold, F.coalesce(marked, empty))
    return out.withColumns({kinds_into: kinds, into: F.when(changed, joined).otherwise(value)}).drop(hold)
