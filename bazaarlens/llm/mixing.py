"""Mixing sources to target weights: certain whole copies, and Pareto order sampling for the rest.

A document is wanted ``level * weight`` times, at most ``most`` times, where the weight is 2 to the power of its grade
and the level of its source is such that the wanted words are the source's target. The grade, in steps of an eighth,
is the preference given by the caller and one by length: half the logarithm of mean length over length, between -1 and 1,
so that a few very long documents do not make up a source's sample. The whole part of that number is certain copies;
the fraction, ``share``, is the chance of one copy more. Documents are ranked by odds(u) / odds(share) with u a fixed
random number of the document, and taken from the front until the words of the rest are reached: Pareto order sampling
of unequal chances, of a size fixed in words. A document that does not fit is passed over: in rounds, those
larger than what is missing are set aside and the others taken on in order, until no free document fits. Then, in
``CLOSING`` steps, a document whose size comes nearest to what is missing is added, or one nearest to what is
too much is left out, and the best of these states is kept.

No source is sorted or gathered. The end of the sample is found by histograms of the ranks: of ``BINS`` bins, and of
as many inside the bin in which the sample ends; the documents of that inner bin, one in 2^28 of the source, are put in order.
A histogram is added up in two steps, so no task gets more than 128 rows of a source. Rounds after the first
read only the documents still free that fit. What decides is then one row per source, joined to the documents;
Spark broadcasts it if its stored size allows, and else splits hot sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, fresh, row_key, shared_folder, stored

MAX_COPIES = 3
BINS = 1 << 14
_COARSE = 128  # bins of a histogram that are added up together first
SEED = 42
# Documents added to a source's filled sample, or taken out, at most to come nearer to its target.
CLOSING = 4
# Grades of preference to a doubling, and how many doublings a preference counts at most.
GRADES = 8
MOST_DOUBLINGS = 8
_KEY = "struct<rank:double,file:bigint,row:bigint>"
_KEYS = f"array<{_KEY}>"
_CUTS = f"array<struct<most:double,last:{_KEY}>>"
_TURNED = "array<struct<sampled:boolean,rank:double,size:bigint>>"
_WORD = r"[^\x20\x09-\x0D]+"


def _measures(df: DataFrame, doc_id: str, text: str, source: str, preference: Column) -> dict[str, Column]:
    """file, row, source, size, u and preference of each row. u depends on id and text alone."""
    content = filled(F.col(text))
    file, row = row_key(df)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(doc_id), F.xxhash64(content)), 11)
    return {
        "file": file,
        "row": row,
        "source": F.col(source),
        "size": F.regexp_count(content, F.lit(_WORD)).cast("long"),
        "u": (bits.cast("double") + 0.5) / float(1 << 53),
        "preference": preference.cast("double"),
    }


def source_targets(sizes: DataFrame, cycle: int = 3, most: float = MAX_COPIES) -> DataFrame:
    """Columns place, source, source_size, mean, target: shares of all words by weight 1, 2, ... ``cycle``, 1, ... in order of source.

    A target stops at ``most`` times the source's size, and what it leaves is shared by weight among the others.
    Sources are taken by how soon they stop: each stops if the level of those left would exceed its limit, so one
    sorted pass over one row per source settles it. ``mean`` is the words of a document that has any.
    """
    total = F.sum("source_size").over(W.partitionBy())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    placed = sources.withColumn("place", place.cast("long"))
    weighed = placed.withColumn("weight", (F.pmod(F.col("place") - 1, F.lit(cycle)) + 1).cast("double")).withColumn("limit", most * F.col("source_size"))
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / heavy).withColumn("stops", F.col("weight") * F.col("level") >= F.col("limit"))
    open_level = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "place", F.col("level").alias("level")))).over(W.partitionBy())
    target = F.when(F.col("stops"), F.col("limit")).otherwise(F.col("weight") * open_level["level"])
    return levels.select("place", "source", "source_size", "mean", target.cast("double").alias("target"))


def _grade() -> Column:
    """The document's preference in steps: that of its length in its source, and the caller's (null or none: the least)."""
    by_length = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log2(F.col("mean") / F.col("size")) / 2))
    given = F.log2(F.least(F.lit(2.0**MOST_DOUBLINGS), F.greatest(F.lit(2.0**-MOST_DOUBLINGS), F.col("preference"))))
    return F.when(F.col("size") > 0, F.round((by_length + given) * GRADES).cast("int"))


def _of_source(measured: DataFrame, plan: DataFrame) -> DataFrame:
    return measured.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _chances(targets: DataFrame, sizes: DataFrame, most: float) -> DataFrame:
    """With ``chances``, by grade the certain copies and the share of one more, and ``rest``, the words to sample.

    Grades are taken from the most wanted down, as sources are in ``source_targets``: each stops at ``most`` copies if
    the level of those left would exceed that. A source has at most 145 grades.
    """
    grades = _of_source(sizes, targets).withColumn("grade", _grade()).filter("size > 0")
    grades = grades.groupBy("place", "target", "grade").agg(F.sum("size").alias("words")).withColumn("weight", F.pow(F.lit(2.0), F.col("grade") / GRADES))
    order = W.partitionBy("place").orderBy(F.col("grade").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum(F.col("words") * F.col("weight")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = grades.withColumn("level", (F.col("target") - most * before) / behind)
    levels = levels.withColumn("stops", F.col("weight") * F.col("level") >= most * (1 - 1e-12))
    level = F.min(F.when(~F.col("stops"), F.struct(-F.col("grade"), F.col("level").alias("level")))).over(W.partitionBy("place"))["level"]
    copies = levels.withColumn("copies", F.when(F.col("stops"), F.lit(float(most))).otherwise(F.col("weight") * level))
    copies = copies.withColumn("whole", F.floor(F.col("copies") + 1e-9))
    share = F.when(F.col("copies") - F.col("whole") > 1e-9, F.col("copies") - F.col("whole")).otherwise(0.0)
    entry = F.struct("grade", F.struct("whole", share.alias("share")).alias("chance"))
    found = copies.groupBy("place").agg(F.map_from_entries(F.collect_list(entry)).alias("chances"), F.sum(F.col("whole") * F.col("words")).alias("certain"))
    rest = F.greatest(F.coalesce(F.col("target") - F.col("certain"), F.lit(0.0)), F.lit(0.0))
    return targets.join(found, "place", "left").withColumn("rest", rest).drop("certain")


def _odds(chance: Column) -> Column:
    return chance / (1 - chance)


def _ranked(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """With the source's plan, certain copies and the document's rank, mapped from (0, inf) to (0, 1) in the same order."""
    graded = _of_source(measured, plan).withColumn("chance", F.try_element_at("chances", _grade())).drop("chances")
    rank = _odds(F.col("u")) / _odds(F.col("chance.share"))
    return graded.withColumns(
        {
            "whole": F.coalesce(F.col("chance.whole"), F.lit(0).cast("long")),
            "rank": F.when((F.col("chance.share") > 0) & (F.col("size") > 0), rank / (1 + rank)),
        }
    ).drop("chance")


def _crossing(bins: DataFrame) -> DataFrame:
    """From place, missing, bin, words: each source's first bin with which the words exceed ``missing``, and those before it.

    Columns place, all_words, bin, before; the last two are null if everything fits.
    """

    def first_over(parts: DataFrame, part: str, base: Column) -> DataFrame:
        order = W.partitionBy("place").orderBy(part)
        upto = parts.withColumn("upto", base + F.sum("words").over(order))
        over = F.when(F.col("upto") > F.col("missing"), F.struct(F.col(part).alias("bin"), (F.col("upto") - F.col("words")).alias("before")))
        return upto.groupBy("place").agg(F.sum("words").alias("all_words"), F.min(over).alias("over"))

    part = F.floor(F.col("bin") / _COARSE)
    coarse = first_over(bins.groupBy("place", "missing", part.alias("part")).agg(F.sum("words").alias("words")), "part", F.lit(0.0))
    coarse = coarse.select("place", "all_words", F.col("over.bin").alias("part"), F.col("over.before").alias("base"))
    fine = bins.withColumn("part", part).join(coarse.select("place", "part", "base"), ["place", "part"])
    fine = first_over(fine, "bin", F.col("base")).select("place", "over.*")
    return coarse.select("place", "all_words").join(fine, "place", "left")


def _filled_on(state: DataFrame, free: DataFrame, folder: str, turn: int) -> DataFrame:
    """One round: the free documents, of at most ``limit`` words, are taken in rank order, up to the first that does not fit.

    The next limit is what is then missing, or half of it if this round has not halved that. A round with half the
    limit halves what is missing or takes all it may, so rounds grow with the logarithm of the words. A source
    is done, its limit 0, when no free document fits.
    """
    scaled = F.col("rank") * BINS
    binned = free.withColumn("bin", F.floor(scaled)).withColumn("inner", F.floor((scaled - F.col("bin")) * BINS))
    missing = state.select("place", "missing")
    bins = binned.groupBy("place", "bin").agg(F.sum("size").alias("words")).join(missing, "place")
    outer = stored(_crossing(stored(bins, folder, f"bins{turn}")), folder, f"outer{turn}")
    inside = stored(binned.join(outer.select("place", "bin", "before"), ["place", "bin"]), folder, f"inside{turn}")
    bins = inside.groupBy("place", "before", F.col("inner").alias("bin")).agg(F.sum("size").alias("words")).join(missing, "place")
    bins = stored(bins.withColumn("missing", F.col("missing") - F.col("before")), folder, f"inner{turn}")
    inner = _crossing(bins).select("place", F.col("bin").alias("inner"), F.col("before").alias("more"))
    inner = stored(inner, folder, f"edge{turn}")

    order = W.partitionBy("place").orderBy("rank", "file", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = inside.join(inner, ["place", "inner"]).join(missing, "place").withColumn("upto", F.col("before") + F.col("more") + F.sum("size").over(order))
    taken = last.filter(F.col("upto") <= F.col("missing")).groupBy("place").agg(F.max("upto").alias("upto"), F.max(F.struct("rank", "file", "row")).alias("cut"))
    # Nothing of the inner bin fits: the sample ends where that bin begins. No such bin: everything fits.
    found = state.join(outer, "place", "left").join(inner, "place", "left").join(taken, "place", "left")
    begin = (F.col("bin") + F.col("inner") / BINS) / BINS
    edge = F.struct(begin.alias("rank"), F.lit(-(1 << 63)).cast("long").alias("file"), F.lit(-1).cast("long").alias("row"))
    everything = F.struct(F.lit(2.0).alias("rank"), F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("row"))
    cut = F.coalesce("cut", F.when(F.col("bin").isNotNull(), edge), everything)
    took = F.coalesce(F.col("upto"), F.col("before") + F.col("more"), F.col("all_words"), F.lit(0)).cast("double")
    found = found.withColumns({"took": took, "step": F.array(F.struct(F.col("limit").alias("most"), cut.alias("last"))).cast(_CUTS)})
    left = F.col("missing") - F.col("took")
    whole_limit = F.col("limit") >= F.col("missing")
    limit = F.when((F.col("limit") < 1) | ((F.col("took") == 0) & whole_limit), 0.0).when((left <= F.col("missing") / 2) | ~whole_limit, left).otherwise(left / 2)
    cuts = F.when(F.col("took") > 0, F.concat("cuts", "step")).otherwise(F.col("cuts"))
    return stored(found.select("place", left.alias("missing"), limit.alias("limit"), cuts.alias("cuts")), folder, f"filled{turn}")


def _before_cut() -> Column:
    """Whether a round has taken the document: it was small enough for it and not behind its last one."""
    return F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (F.struct("rank", "file", "row") <= c["last"]))


def _sampled() -> Column:
    """Whether a document is in its source's sample: taken in a round, unless a later step has turned that round."""
    return _before_cut() != F.array_contains("closing", F.struct("rank", "file", "row"))


def _closed(state: DataFrame, ranked: DataFrame, folder: str) -> DataFrame:
    """``closing``: the documents of each source that closing steps add or leave out.

    One document of every size, in the sample and outside, is there to choose from: one pass over the documents, and the
    steps themselves read a row per size. A step may overshoot, as the next can make up for it.
    """
    marked = ranked.join(state.select("place", "cuts"), "place").withColumn("sampled", _before_cut()).drop("cuts")
    pool = stored(marked.groupBy("place", "sampled", "size").agg(F.min("rank").alias("rank")), folder, "pool")
    none = F.array().cast(_TURNED)
    steps = state.select("place", "missing", none.alias("turned"), none.alias("best"), F.abs("missing").alias("best_off"))
    one = F.struct("sampled", "rank", "size")
    for turn in range(CLOSING):
        spare = pool.join(steps, "place").filter((F.abs("missing") >= 0.5) & (F.col("sampled") == (F.col("missing") < 0)) & ~F.array_contains("turned", one))
        nearest = F.min(F.struct(F.abs(F.col("size") - F.abs("missing")), "rank", "sampled", "size"))
        steps = steps.join(spare.groupBy("place").agg(nearest.alias("next")), "place", "left")
        more = F.concat("turned", F.array(F.struct("next.sampled", "next.rank", "next.size")).cast(_TURNED))
        left = F.coalesce(F.col("missing") - F.signum("missing") * F.col("next.size"), F.col("missing"))
        steps = steps.withColumns({"turned": F.when(F.col("next").isNull(), F.col("turned")).otherwise(more), "missing": left}).drop("next")
        nearer = F.abs("missing") < F.col("best_off")
        steps = steps.withColumns({"best": F.when(nearer, F.col("turned")).otherwise(F.col("best")), "best_off": F.least("best_off", F.abs("missing"))})
        steps = stored(steps, folder, f"closed{turn}")
    # Equal rows have equal ranks: of those, one is turned.
    chosen = steps.select("place", F.explode("best").alias("one")).select("place", "one.*")
    rows = marked.join(chosen, ["place", "sampled", "rank", "size"]).groupBy("place", "sampled", "rank", "size").agg(F.min(F.struct("file", "row")).alias("at"))
    return rows.groupBy("place").agg(F.collect_list(F.struct("rank", "at.file", "at.row")).alias("closing"))


def mixing_plan(spark: SparkSession, sizes: DataFrame, folder: str, cycle: int = 3, most: float = MAX_COPIES) -> DataFrame:
    """What decides about a source's documents, one row per source: chances by grade, where its sample ends, and what closes it."""
    targets = stored(source_targets(sizes, cycle, most), folder, "targets")
    plan = stored(_chances(targets, sizes, most), folder, "plan")
    ranked = stored(_ranked(sizes, plan).filter(F.col("rank").isNotNull()).select("place", "size", "rank", "file", "row"), folder, "ranked")
    state = plan.select("place", F.col("rest").alias("missing"), F.col("rest").alias("limit"), F.array().cast(_CUTS).alias("cuts"))
    free = ranked.join(state.select("place", "limit"), "place").filter("size <= limit").drop("limit")
    turn = 0
    while True:
        state = _filled_on(state, free, folder, turn)
        if (state.agg(F.max("limit")).first()[0] or 0) < 1:
            break
        left = free.join(state.select("place", "limit", "cuts"), "place").filter((F.col("size") <= F.col("limit")) & ~_before_cut())
        free = stored(left.select("place", "size", "rank", "file", "row"), folder, f"free{turn}")
        turn += 1
    closing = _closed(state, ranked, folder)
    plan = plan.join(state.select("place", "cuts"), "place").join(closing, "place", "left")
    plan = plan.withColumn("closing", F.coalesce("closing", F.array().cast(_KEYS)))
    return stored(plan.drop("rest", "place"), folder, "decided")


def _copies() -> Column:
    more = F.col("rank").isNotNull() & _sampled()
    return F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0).cast("long"))


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cycle: int = 3,
    most: float = MAX_COPIES,
    preference: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: how many copies the mix takes of it.

    Sizes are words (runs without ASCII white space); null text has none. A null source is a source, the last one.
    Documents without words are never taken; a source without words has target 0. ``preference`` (a positive
    column, 1 by default; null, zero and less count as the least, 1/256) multiplies the copies wanted of a document. Equal rows have
    equal rank; which of them is taken does not change the result. An empty table gives an empty result, and other
    columns are not read. Columns: file, row, doc_id, source, size, source_size, target, taken (words) and copies.
    """
    folder = shared_folder(spark)
    measures = _measures(docs, doc_id, text, source, F.lit(1.0) if preference is None else preference)
    sizes = stored(docs.select(F.col(doc_id).alias("doc_id"), *(c.alias(n) for n, c in measures.items())), folder, "sizes")
    plan = mixing_plan(spark, sizes, folder, cycle, most)
    return _ranked(sizes, plan).select(
        "file", "row", "doc_id", "source", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"), _copies().alias("copies")
    )


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with ``copy`` from 1 and ``taken``.

    A document's copies follow from its own row and its source's row of the plan, so the texts are not joined to
    the decisions: they are measured again in the scan and, unless there are very many sources, never shuffled.
    Texts without words, null ones included, are never taken; a null source is a source. An empty table stays empty; all
    columns pass as they are, and the two new ones get underscores in front where their names are taken.
    """
    folder = shared_folder(spark)
    measures = [c.alias(n) for n, c in _measures(docs, "doc_id", "text", "source", F.lit(1.0)).items()]
    plan = mixing_plan(spark, stored(docs.select(*measures), folder, "sizes"), folder)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    decided = _ranked(docs.select(whole, *measures), plan).withColumn("copies", _copies()).filter("copies > 0")
    taken, copy = fresh(docs, "taken", "copy")
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return decided.select(
        *(F.col("document").getField(c).alias(c) for c in docs.columns), (F.col("copies") * F.col("size")).alias(taken), each.alias(copy)
    )
