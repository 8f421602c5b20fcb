"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds one posting (term, row, position) for each occurrence in the training texts of a term that a benchmark
window uses, and one closing posting a row with its number of words; it is written once. A window is WINDOW consecutive words of
an item (all its words, if fewer). Its terms are ranked by their counts in the index: the rarest term's list, adjusted
by the term's offset, gives candidate starts; the second rarest term's adjusted list cuts them; the other terms' lists
confirm what is left, so matches are exact. ``proximity`` finds items whose rarest terms come close together instead.

Null and empty texts have no words, items without words have no window, repeated rows count on their own (the index
numbers rows, not ids), several rows of one item_id are one item, an empty benchmark hits nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellframe.spark import settle

WINDOW = 10
#: Largest lookup, in bytes, that is sent to every task; a larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 32 << 20
#: Rank among a window's terms: the first makes candidates, the second cuts them.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends each row's words; never a word itself.
_CLOSE = "\n"


def split_words(text: Column) -> Column:
    """Text cut at what is no word: an array whose first and last entries may be empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, runs without ASCII signs."""
    return F.filter(split_words(text), lambda w: w != "")


def _small(df: DataFrame, width: Column, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The settled frame, marked for broadcast only after its bytes were summed and found below the limit."""
    size = df.agg(F.sum(width + 16).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= limit else df


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """window (array of words), item_id: the distinct windows of items (item_id, text)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - length)
    starts = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select(F.slice("w", F.col("at") + 1, length).alias("window"), "item_id").distinct()


def terms_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, item_id) and (wid, offset, term, length) of windows; a wid stands for one sequence of words."""
    keyed = found.withColumn("wid", F.sha2(F.concat_ws(" ", "window"), 256))
    items = settle(keyed.select("wid", "item_id"))
    terms = keyed.dropDuplicates(["wid"]).select("wid", F.size("window").alias("length"), F.posexplode("window").alias("offset", "term"))
    return items, settle(terms)


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written index of rows (rid, doc_id, text) for the terms (wid, offset, term, length).

    Rows (term, rid, pos, doc_id): a posting has no doc_id; the closing posting of a row has term null, its doc_id and
    as position the number of words."""
    vocabulary = settle(terms.select("term").distinct().unionAll(docs.sparkSession.createDataFrame([(_CLOSE,)], "term string")))
    cut = split_words(F.col("text"))
    rows = docs.select("rid", "doc_id", cut.alias("w"))
    first = (F.element_at("w", 1) == "").cast("int")
    last = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    rows = rows.select("rid", "doc_id", first.alias("first"), last.alias("last"), F.posexplode(F.concat("w", F.array(F.lit(_CLOSE)))).alias("at", "term"))
    kept = rows.join(_small(vocabulary, F.length("term")), "term")
    closing = F.col("term") == _CLOSE
    place = F.col("at") - F.col("first") - F.when(closing, F.col("last")).otherwise(0)
    return settle(kept.select(F.when(~closing, F.col("term")).alias("term"), "rid", place.alias("pos"), F.when(closing, F.col("doc_id")).alias("doc_id")))


def ranked(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of windows with their rank by count in the index; windows with a term that never occurs are left out."""
    counts = postings.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    known = terms.join(counts, "term", "left")
    by = W.partitionBy("wid")  # a window has few terms
    known = known.withColumn("rank", F.row_number().over(by.orderBy("n", "offset"))).withColumn("_all", F.count("n").over(by) == F.col("length"))
    return settle(known.filter("_all").select("wid", "length", "offset", "term", "n", "rank"))


def occurrences(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """wid, rid, start, length: every place where all words of a window stand in order."""
    plan = ranked(postings, terms)
    lists = postings.filter("term is not null").select("term", "rid", "pos")
    key = F.length("term") + 64
    rarest = _small(plan.filter("rank = 1").select("term", "wid", "offset", "length"), key)
    candidates = lists.join(rarest, "term").select("wid", "rid", (F.col("pos") - F.col("offset")).alias("start"), "length")
    second = settle(plan.filter("rank = 2"))
    wanted = lists.join(_small(second.select("term").distinct(), key), "term", "left_semi")
    expected = candidates.join(_small(second.select("wid", "offset", "term"), key), "wid", "left")
    expected = expected.withColumn("pos", F.col("start") + F.coalesce("offset", F.lit(0)))
    single = expected.filter("term is null")  # windows of one word
    cut = expected.filter("term is not null").join(wanted, ["term", "rid", "pos"], "left_semi")
    cut = settle(cut.unionByName(single).select("wid", "rid", "start", "length").distinct())
    rest = cut.join(_small(plan.filter("rank > 2").select("wid", "offset", "term"), key), "wid")
    rest = rest.select("wid", "rid", "start", "length", "term", (F.col("start") + F.col("offset")).alias("pos"))
    rows = settle(cut.select("rid").distinct())
    here = lists.join(_small(rows, F.lit(8)), "rid", "left_semi")
    full = rest.join(here, ["term", "rid", "pos"]).groupBy("wid", "rid", "start", "length").agg(F.count("*").alias("n")).filter("n = length - 2").drop("n")
    return full.unionByName(cut.filter("length <= 2"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with row numbers; the index that is built of them is written in one go, so they hold."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")


def clean(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    whole = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")))
    _, terms = terms_of(windows(items, length))
    postings = index(whole.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), terms)
    hit = settle(occurrences(postings, terms).select("rid").distinct())
    return whole.join(_small(hit, F.lit(8)), "rid", "left_anti").select("row.*")


def report(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    of_items, terms = terms_of(windows(items, length))
    postings = index(numbered(docs), terms)
    found = settle(occurrences(postings, terms))
    spans = found.select("rid", "start", "length").distinct()
    hit = spans.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    hit = hit.groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = found.select("rid", "wid").distinct().join(_small(of_items, F.lit(72)), "wid").select("rid", F.col("item_id").cast("string").alias("i")).distinct()
    names = names.groupBy("rid").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("i"))).alias("ids"))
    rows = postings.filter("term is null").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hit, "rid", "left").join(names, "rid", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, terms: int = 4, within: int = 30) -> DataFrame:
    """doc_id, item_id, nearest: rows where the item's ``terms`` rarest words all stand within ``within`` words of an
    occurrence of the rarest one, and the smallest such reach. Lists meet by row and block of positions."""
    by_item = items.select("item_id", F.posexplode(F.array_distinct(words(F.col("text")))).alias("offset", "term"))
    by_item = by_item.groupBy("item_id", "term").agg(F.min("offset").alias("offset"))
    size = by_item.groupBy("item_id").agg(F.count("*").cast("int").alias("length"))
    wanted = settle(by_item.join(size, "item_id").withColumnRenamed("item_id", "wid"))
    postings = index(numbered(docs), wanted)
    plan = ranked(postings, wanted).filter(F.col("rank") <= terms)
    lists = postings.filter("term is not null").select("term", "rid", "pos")
    need = F.least(F.col("length"), F.lit(terms))
    rare = lists.join(plan.filter("rank = 1").select("term", "wid", need.alias("need")), "term").select("wid", "rid", F.col("pos").alias("at"), "need")
    spread = rare.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col("at") / within) + d)))
    others = lists.join(plan.select("term", "wid"), "term").withColumn("block", F.floor(F.col("pos") / within))
    near = spread.join(others, ["wid", "rid", "block"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    closest = near.groupBy("wid", "rid", "at", "need", "term").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("d"))
    full = closest.groupBy("wid", "rid", "at", "need").agg(F.count("*").alias("n"), F.max("d").alias("d")).filter("n = need")
    best = full.groupBy("wid", "rid").agg(F.min("d").alias("nearest"))
    ids = postings.filter("term is null").select("rid", "doc_id")
    return best.join(ids, "rid").select("doc_id", F.col("wid").alias("item_id"), F.col("nearest").cast("int").alias("nearest"))
