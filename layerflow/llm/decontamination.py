"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact check."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import query, small, table, text_or_empty
from layerflow.session import cut

SHINGLE = 5
SIMILAR = 0.75

#: 64-bit fingerprints in 8 blocks of 8 bits. If two of them differ in at most 23 bits, some
#: block differs in at most 2; every item is filed under all values of a block within 2 bits.
BLOCKS, WIDTH, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Counters of bits that share a long integer, and their width: a window has fewer shingles
#: than an array has places, which 31 bits hold.
PACKED, FIELD = 2, 31


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: str, size: int) -> Column:
    """At each place of an array the words from there on, as a struct of ``size``."""
    return F.arrays_zip(*[(F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) if i else F.col(words)).alias(f"w{i}") for i in range(size)])


def _run_hash(run: Column, size: int) -> Column:
    return F.xxhash64(*[run.getField(f"w{i}") for i in range(size)])


def _hashes(words: str, size: int) -> Column:
    runs = F.slice(_runs(words, size), 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(runs, lambda run: _run_hash(run, size))


def _simhash(grams: DataFrame, key: list[str]) -> DataFrame:
    """The fingerprint of each key over its rows (key, h, n): a bit is set if more than half of
    the shingles, by weight, have it set in their hash."""
    shift = lambda c, by: F.call_function("shiftrightunsigned", c, F.lit(by))
    bit = lambda b: shift(F.col("h"), b).bitwiseAND(1) * F.col("n")
    groups = [range(i, min(i + PACKED, 64)) for i in range(0, 64, PACKED)]
    sums = [
        F.sum(sum((F.call_function("shiftleft", bit(b), F.lit(FIELD * j)) for j, b in enumerate(g)), F.lit(0).cast("long"))).alias(f"s{i}")
        for i, g in enumerate(groups)
    ]
    summed = grams.groupBy(*key).agg(F.sum("n").alias("weight"), *sums)
    set_ = [
        F.when(shift(F.col(f"s{i}"), FIELD * j).bitwiseAND((1 << FIELD) - 1) * 2 > F.col("weight"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        for i, g in enumerate(groups)
        for j, _ in enumerate(g)
    ]
    print_ = F.lit(0).cast("long")
    for b, c in enumerate(set_):
        print_ = print_.bitwiseOR(F.call_function("shiftleft", c, F.lit(b)))
    return summed.select(*key, "weight", print_.alias("print"))


def _blocks(df: DataFrame, keep: list[str], masks: list[int]) -> DataFrame:
    """A row for each block of the fingerprint and each mask: (keep, block, value)."""
    parts = F.array(*[F.call_function("shiftrightunsigned", F.col("print"), F.lit(WIDTH * b)).bitwiseAND((1 << WIDTH) - 1) for b in range(BLOCKS)])
    rows = df.select(*keep, "print", F.posexplode(parts).alias("block", "part"))
    return rows.select(*keep, "print", "block", F.explode(F.transform(F.lit(masks), lambda m: F.col("part").bitwiseXOR(m))).alias("value"))


def _masks() -> list[int]:
    """All values of a block with at most NEAR bits set."""
    return [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(WIDTH), k)]


def _windows(hits: DataFrame, similar: float) -> DataFrame:
    """The windows (text_md5, m, g, start) in which so many shingles are those of items of m
    words that one of them can be similar.

    If a window has similarity s to an item, they share s / (1 + s) of both their weights. A
    window spans at most two blocks of places as long as itself; the places with such shingles
    are gathered by block, and no array is longer than two windows. The windows whose first
    such place is the i-th one begin behind the place before it, and must reach the place
    that fills the number needed.
    """
    g, m, size = F.col("g"), F.col("m"), F.col("size")
    span = F.least(m, size) - g + 1
    need = F.greatest(F.ceil((span + m - g + 1) * similar / (1 + similar) - 1e-6), F.lit(1)).cast("int")
    key = ["text_md5", "m", "g", "size"]
    blocks = hits.withColumn("block", F.floor(F.col("p") / span)).groupBy(*key, "block").agg(F.collect_set("p").alias("ps"))
    begun = blocks.select(*key, "ps", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block")).where("block >= 0")
    begun = begun.groupBy(*key, "block").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("ps"))
    begun = begun.select(*key, (F.col("block") * span).cast("int").alias("low"), "ps", need.alias("need")).where(F.size("ps") >= F.col("need"))
    fills = F.slice("ps", F.col("need"), F.size("ps"))
    before = F.concat(F.array(F.col("low") - 1), F.col("ps"))
    runs = F.slice(F.arrays_zip(F.col("ps").alias("p"), fills.alias("fill"), before.alias("before")), F.lit(1), F.size("ps") - F.col("need") + 1)
    begun = begun.select(*key, "low", F.explode(runs).alias("run"))
    first = F.greatest(F.col("run.fill") - span + 1, F.col("run.before") + 1, F.col("low"))
    last = F.least(F.col("run.p"), F.col("low") + span - 1, F.greatest(size - m, F.lit(0)))
    begun = begun.select("text_md5", "m", "g", first.alias("first"), last.alias("last")).where("first <= last")
    return begun.select("text_md5", "m", "g", F.explode(F.sequence("first", "last")).alias("start"))


def find_leaks(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Benchmark items in texts: (text_md5, item_id, similarity, first_word), one row for each
    text and item.

    A text is compared with an item in windows of as many words as the item has. The
    similarity is that of the sets of 5-word shingles weighted by how often they occur:
    the sum of the smaller over the sum of the larger weights; shorter items and texts are one
    shingle. Windows begin at every word; those with too few shingles of items to be similar
    to any get no fingerprint. Of texts shorter than the item the whole is the window. Fingerprints are compared within RADIUS bits by block lookup, so that none within
    it is missed: at similarity 0.75 shingle vectors are at 31 degrees and fingerprints differ
    in 11 bits of 64 on average, with a deviation of 3. Candidates are then compared exactly.

    Null and empty texts and items have no words and no leak. Equal texts are found as one;
    ``first_word`` is the place of the first of the best windows. Items are told
    apart by their words and not by their ids: ids, null as well, are joined at the end, and an
    id with several items has the best of them.
    """
    spark = docs.sparkSession
    known = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = known.withColumn("item", F.md5(F.array_join("words", " ")))
    ids = known.select("item", "item_id").distinct()
    known = known.select("item", "words", F.size("words").alias("m")).dropDuplicates(["item"])
    sizes = sorted(r[0] for r in known.select(F.least("m", F.lit(SHINGLE))).distinct().collect())  # 1 to 5
    if not sizes:
        return spark.createDataFrame([], "text_md5 string, item_id long, similarity double, first_word long")
    item_grams = None
    for g in sizes:
        own = known.where(F.col("m") == g) if g < SHINGLE else known.where(F.col("m") >= g)
        own = own.select("item", "m", F.lit(g).alias("g"), F.posexplode(_hashes("words", g)).alias("q", "h"))
        item_grams = own if item_grams is None else item_grams.unionByName(own)
    item_grams = cut(item_grams)
    places = small(cut(item_grams.select("g", "h", "m").distinct()))

    texts = docs.select(F.md5(text_or_empty()).alias("text_md5"), words_of(F.col("text")).alias("words"))
    hits = None
    for g in sizes:
        rows = texts.select("text_md5", F.size("words").alias("size"), F.posexplode(_runs("words", g)).alias("p", "run"))
        rows = rows.where(F.col("p") <= F.col("size") - g).select("text_md5", "size", "p", F.lit(g).alias("g"), _run_hash(F.col("run"), g).alias("h"))
        hits = rows if hits is None else hits.unionByName(rows)
    windows = cut(_windows(hits.join(places, ["g", "h"]), similar))

    # The shingles of those windows, from the texts that have any.
    hit_texts = small(cut(windows.select("text_md5").distinct()))
    again = docs.select(F.md5(text_or_empty()).alias("text_md5"), F.col("text")).join(hit_texts, "text_md5", "left_semi")
    again = again.groupBy("text_md5").agg(F.max("text").alias("text")).withColumn("words", words_of(F.col("text")))
    grams = None
    for g in sizes:
        one = again.select("text_md5", _hashes("words", g).alias("hashes")).join(windows.where(F.col("g") == g), "text_md5")
        one = one.select("text_md5", "m", "start", F.explode(F.slice("hashes", F.col("start") + 1, F.col("m") - (g - 1))).alias("h"))
        grams = one if grams is None else grams.unionByName(one)
    window = ["text_md5", "m", "start"]
    grams = cut(grams.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("n")))
    item_counts = item_grams.groupBy("item", "m", "h").agg(F.count(F.lit(1)).alias("n"))

    prints = cut(_simhash(grams, window))
    item_prints = cut(_simhash(item_counts, ["item", "m"]))
    filed = _blocks(item_prints.withColumnRenamed("weight", "item_weight"), ["item", "m", "item_weight"], _masks())
    filed = filed.withColumnRenamed("print", "item_print")
    asked = _blocks(prints, [*window, "weight"], [0])
    near = asked.join(filed, ["m", "block", "value"]).where(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    )
    pairs = near.select(*window, "item", "weight", "item_weight").distinct()
    shared = pairs.join(grams, window).join(item_counts.withColumnRenamed("n", "item_n"), ["item", "m", "h"])
    shared = shared.groupBy(*window, "item", "weight", "item_weight").agg(F.sum(F.least("n", "item_n")).alias("both"))
    alike = F.col("both") / (F.col("weight") + F.col("item_weight") - F.col("both"))
    shared = shared.withColumn("similarity", alike).where(F.col("similarity") >= similar)
    best = F.max_by("start", F.struct("similarity", -F.col("start")))
    found = shared.groupBy("text_md5", "item").agg(
        F.max("similarity").alias("similarity"), best.cast("long").alias("first_word")
    )
    found = found.join(ids, "item").groupBy("text_md5", "item_id")
    return found.agg(F.max("similarity").alias("similarity"), F.max_by("first_word", F.struct("similarity", -F.col("first_word"))).alias("first_word"))


def leaked_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, similarity, first_word) for each row of ``docs`` with a leaked item."""
    found = small(cut(find_leaks(docs, items)))
    rows = docs.select(F.col(key), F.md5(text_or_empty()).alias("text_md5"))
    return rows.join(found, "text_md5").select(key, "item_id", "similarity", "first_word")


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leaked item, with all their columns; other rows stay
    as they are, also those with null or empty text."""
    found = cut(find_leaks(docs, items).select("text_md5").distinct())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.md5(text_or_empty()).alias("text_md5"))
    return rows.join(small(found), "text_md5", "left_anti").select("row.*")


OP6_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, array_to_string(w, ' ') AS item, w, len(w) AS m, least(len(w), 5) AS g FROM i WHERE len(w) > 0),
ih AS (SELECT item, m, g, array_to_string(w[q + 1:q + g], ' ') AS h
  FROM (SELECT item, m, g, w, unnest(range(0, m - g + 1)) AS q FROM (SELECT DISTINCT item, w, m, g FROM x))),
z AS (SELECT DISTINCT g FROM x),
d AS (SELECT DISTINCT md5(coalesce(text, '')) AS k, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
dg AS (SELECT k, len(w) AS n, w, g, unnest(range(0, len(w) - g + 1)) AS p FROM d JOIN z ON len(w) >= g),
dh AS (SELECT k, n, g, p, array_to_string(w[p + 1:p + g], ' ') AS h FROM dg),
hit AS (SELECT DISTINCT k, n, m, g, p FROM dh JOIN (SELECT DISTINCT h, m, g FROM ih) USING (h, g)),
sp AS (SELECT k, n, m, g, unnest(range(greatest(least(p + g, n) - least(m, n), 0), least(p, greatest(n - m, 0)) + 1)) AS start FROM hit),
s AS (SELECT k, m, g, start, count(*) AS shared FROM sp GROUP BY k, n, m, g, start
  HAVING count(*) * 1.75 >= 0.75 * (least(any_value(n), m) - g + 1 + m - g + 1) - 0.001),
wg AS (SELECT s.k, s.m, s.start, dh.h, count(*) AS n FROM s JOIN dh ON s.k = dh.k AND s.g = dh.g AND dh.p BETWEEN s.start AND s.start + s.m - s.g GROUP BY ALL),
ws AS (SELECT k, m, start, sum(n) AS weight FROM wg GROUP BY ALL),
ic AS (SELECT item, m, h, count(*) AS n FROM ih GROUP BY ALL),
iw AS (SELECT item, m, sum(n) AS weight FROM ic GROUP BY ALL),
b AS (SELECT wg.k, wg.m, wg.start, ic.item, sum(least(wg.n, ic.n)) AS both_n FROM wg JOIN ic ON wg.m = ic.m AND wg.h = ic.h GROUP BY ALL),
v AS (SELECT b.k, b.item, b.start, b.both_n::DOUBLE / (ws.weight + iw.weight - b.both_n)::DOUBLE AS similarity
  FROM b JOIN ws USING (k, m, start) JOIN iw ON iw.item = b.item),
f AS (SELECT k, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start)) AS first_word
  FROM v JOIN (SELECT DISTINCT item, item_id FROM x) USING (item) WHERE similarity >= 0.75 GROUP BY k, item_id)
SELECT doc_id, item_id, similarity, first_word::BIGINT AS first_word
FROM documents JOIN f ON md5(coalesce(text, '')) = f.k
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that leaked into documents."""
    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
