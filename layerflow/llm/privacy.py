"""Personal data: patterns, and terms that disclose them by how they occur in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import query, table, text_or_empty
from layerflow.session import cut

KINDS = ("email", "ip", "card", "phone")
#: Keys and other secrets: long strings that no word list has, told by their own characters.
KEY = "key"
PROTECTED = (*KINDS, KEY)
#: The kind of a span that covers a disclosing term; it sorts behind the protected kinds.
TERM = "term"

#: The patterns, so written that a failed start is never tried again within the same run of
#: characters: a match begins where its run of characters begins or where the match before it
#: ended, and runs are taken whole. The matches are those of the plain patterns. None holds a
#: line feed, so a text may be searched line by line.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
#: What every line with a match of some kind has.
HINT = r"@|[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){8}|\+[0-9]|[0-9][A-Za-z]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

#: A key has at least so many different characters, and so often a digit next to a letter.
#: Words, numbers, dates and paths have few such places.
KEY_CHARACTERS = 10
KEY_CHANGES = 4

#: A term discloses a kind of personal data if it tells this part of the information that the
#: kind's presence carries, and beside at least so many different lines with that kind.
DISCLOSED = 0.8
SUPPORT = 5
#: Terms that tell this part are removed, others are generalised.
REMOVED = 0.95
#: Texts are rewritten in pieces of so many code points.
PIECE = 4096

SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    changes = F.regexp_count(match, F.lit("[A-Za-z][0-9]")) + F.regexp_count(match, F.lit("[0-9][A-Za-z]"))
    return {
        "email": F.lit(True),
        "ip": match.rlike(IP_PARTS),
        "card": F.when(size.between(12, 19), _luhn(digits)).otherwise(F.lit(False)),
        "phone": size.between(9, 15),
        "key": (changes >= KEY_CHANGES) & (F.size(F.array_distinct(F.split(match, ""))) >= KEY_CHARACTERS),
    }[kind]


def _bit(kind: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), kind)


def _pairs(text: Column, pattern: str) -> Column:
    """The matches of a pattern, each with the length of the text before it; a last pair without
    a match is the rest. Splitting by the pattern gives the text between the matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def hinted_lines(found: DataFrame) -> DataFrame:
    """The lines of (rid, text) that may hold matches: (rid, line, at, unit), ``at`` being where
    the line begins. Only lengths of the other lines are moved."""
    lines = found.where("text is not null").select("rid", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    lines = lines.select("rid", "line", F.length("unit").alias("size"), F.when(F.col("unit").rlike(HINT), F.col("unit")).alias("unit"))
    before = Window.partitionBy("rid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("long")
    return lines.withColumn("at", at).where("unit is not null").select("rid", "line", "at", "unit")


def line_spans(lines: DataFrame) -> DataFrame:
    """The matches in lines: (rid, line, kind, start, end), in code points of the text, end
    exclusive. Places are running sums of lengths, so a line with very many matches costs no
    more than its length and a sort."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), _pairs(F.col("unit"), PATTERNS[kind]).alias("pairs")) for k, kind in enumerate(PROTECTED)])
    apart = lines.select("rid", "line", "at", F.explode(each).alias("of")).where(F.size("of.pairs") > 1)
    pairs = apart.select("rid", "line", "at", F.col("of.kind").alias("kind"), F.posexplode("of.pairs").alias("place", "pair"))
    size = F.coalesce(F.length("pair.hit"), F.lit(0))
    run = Window.partitionBy("rid", "line", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = pairs.withColumn("end", (F.col("at") + F.sum(F.col("pair.gap") + size).over(run)).cast("long"))
    holds = F.lit(False)
    for k, kind in enumerate(PROTECTED):
        holds = F.when(F.col("kind") == k, _holds(kind, F.col("pair.hit"))).otherwise(holds)
    placed = placed.where(F.col("pair.hit").isNotNull() & holds)
    return placed.select("rid", "line", "kind", (F.col("end") - size).alias("start"), "end")


def terms_of(text: Column) -> Column:
    """The words of a text in lower case: runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def marked_terms(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The words of the lines that have spans, without those that share a character with one:
    (rid, line, unit, kinds, term, start, end). ``unit`` is a hash of the line; ``kinds`` are
    those on the line as bits.

    Words and spans of a line are swept once forwards, for spans that begin before a word ends
    it, and once backwards, for spans that begin inside it.
    """
    kinds = spans.groupBy("rid", "line").agg(F.bit_or(_bit(F.col("kind"))).alias("kinds"))
    held = lines.join(kinds, ["rid", "line"])
    words = held.select("rid", "line", "at", "kinds", F.xxhash64("unit").alias("unit"), F.posexplode(_pairs(F.col("unit"), r"\p{L}+")).alias("place", "pair"))
    size = F.coalesce(F.length("pair.hit"), F.lit(0))
    run = Window.partitionBy("rid", "line").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("end", (F.col("at") + F.sum(F.col("pair.gap") + size).over(run)).cast("long"))
    words = words.withColumn("start", F.col("end") - size).where("pair.hit is not null")
    words = words.select("rid", "line", "unit", "kinds", F.lower("pair.hit").alias("term"), "start", "end")
    both = words.unionByName(spans.select("rid", "line", "start", "end"), allowMissingColumns=True)
    isa = F.col("term").isNull()
    ahead = Window.partitionBy("rid", "line").orderBy("start", isa.desc()).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("rid", "line").orderBy(F.desc("start"), isa).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.select(
        "*",
        F.coalesce(F.max(F.when(isa, F.col("end"))).over(ahead), F.lit(-1)).alias("covered"),
        F.min(F.when(isa, F.col("start"))).over(back).alias("next"),
    )
    free = (F.col("covered") <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return swept.where(~isa & free).drop("covered", "next")


def disclosing_terms(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Terms by which readers can tell that personal data stood beside them: (term, kind, told).

    Lines are the contexts. For a term t and a kind c the corpus gives p(c) and p(c | t); the
    pointwise mutual information log p(c|t) / p(c), as a part of the information -log p(c) of
    the kind itself, is what t tells of c. Repeated lines with personal data count once, so a
    copied line does not make its words disclosing. The counts cover all lines of ``docs``.
    """
    each = marked.select("unit", "kinds", "term").distinct()
    apart = [F.col("kinds").bitwiseAND(1 << k) != 0 for k in range(len(PROTECTED))]
    kinds = F.explode(F.array_compact(F.array(*[F.when(has, F.lit(k)) for k, has in enumerate(apart)])))
    joint = each.select("term", kinds.alias("kind")).groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n_both"))
    joint = joint.where(F.col("n_both") >= SUPPORT)
    raw = marked.select("rid", "line", "kinds", "term").distinct().select("term", kinds.alias("kind"))
    raw = raw.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("n_raw"))
    text = text_or_empty()
    units = docs.select(F.explode(F.split(text, "\n")).alias("unit"))
    hashed = F.transform(terms_of(F.col("unit")), lambda w: F.xxhash64(w))
    counts = units.select(F.explode(F.array_distinct(hashed)).alias("hashed")).groupBy("hashed").agg(F.count(F.lit(1)).alias("n_term"))
    # A count of all lines and one for each of the kinds.
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n_lines = float(docs.agg(F.sum(ends + 1).alias("n")).first()["n"] or 0)
    n_kind = {r["kind"]: r["n"] for r in each.select("unit", kinds.alias("kind")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    of_all = F.element_at(F.array(*[F.lit(n_kind.get(k, 0) / max(n_lines, n_kind.get(k, 0), 1.0)) for k in range(len(PROTECTED))]), F.col("kind") + 1)
    known = joint.join(raw, ["term", "kind"]).withColumn("hashed", F.xxhash64("term")).join(counts, "hashed")
    within = F.col("n_both") / (F.col("n_both") + F.greatest(F.col("n_term") - F.col("n_raw"), F.lit(0)))
    told = F.when((of_all > 0) & (of_all < 1), F.log(within / of_all) / -F.log(of_all)).otherwise(F.lit(0.0))
    return known.select("term", "kind", told.alias("told")).where(F.col("told") >= DISCLOSED)


def find_personal_data(docs: DataFrame, keep: list[str], sanitise: bool = False) -> DataFrame:
    """The columns ``keep`` of all rows, with ``spans``, ``terms`` and, if asked for,
    ``sanitised``.

    ``spans`` are those of the patterns by start and kind, ``terms`` those of disclosing terms on
    lines with the kind that they disclose, as (start, end, told). ``sanitised`` is the text
    without them, null for rows that have none. A null text is empty. Equal texts have equal
    spans. Rows, and the texts of those that may have spans, are written to the shared folder
    once and read for everything after.
    """
    text = text_or_empty()
    found = cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            *[F.col(k) for k in keep],
            F.when(text.rlike(HINT), text).alias("text"),
        )
    )
    lines = hinted_lines(found)
    spans = cut(line_spans(lines))
    marked = cut(marked_terms(lines, spans))
    telling = disclosing_terms(docs, marked)
    hits = marked.join(telling, "term").where(F.call_function("shiftright", F.col("kinds"), F.col("kind")).bitwiseAND(1) == 1)
    terms = cut(hits.groupBy("rid", "start", "end").agg(F.max("told").alias("told")))
    own = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    more = terms.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "told"))).alias("terms"))
    none = F.array()
    out = found.join(own, "rid", "left").join(more, "rid", "left")
    if sanitise:
        out = out.join(redacted(found, spans, terms), "rid", "left")
    return out.select(
        *keep,
        F.coalesce("spans", none.cast(SPAN)).alias("spans"),
        F.coalesce("terms", none.cast("array<struct<start: bigint, end: bigint, told: double>>")).alias("terms"),
        *(["sanitised"] if sanitise else []),
    )


def redacted(found: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, sanitised) of the texts with spans: spans are replaced by their kind in brackets,
    disclosing terms by ``[TERM]``, and those that tell nearly all are removed. Of overlapping
    spans the first one stands for all.

    Spans that overlap are made one, and dealt to the pieces of the text that they touch; each
    piece is rewritten by itself and the pieces are joined again.
    """
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in PROTECTED])
    marks = spans.select("rid", "start", "end", F.element_at(kinds, F.col("kind") + 1).alias("put"))
    marks = marks.unionByName(terms.select("rid", "start", "end", F.when(F.col("told") >= REMOVED, "").otherwise("[TERM]").alias("put")))
    order = Window.partitionBy("rid").orderBy("start", "end", "put")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("first", F.coalesce(F.col("start") >= before, F.lit(True)))
    marks = marks.withColumn("island", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = marks.groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("first"), F.col("put"))).alias("put"))
    size = F.lit(PIECE)
    marks = marks.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    here = F.col("piece") * size
    marks = marks.select(
        "rid",
        "piece",
        F.struct(
            (F.greatest("start", here) - here).alias("start"),
            (F.least("end", here + size) - here).alias("end"),
            F.when(F.col("start") >= here, F.col("put")).otherwise("").alias("put"),
        ).alias("mark"),
    )
    marks = marks.groupBy("rid", "piece").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    texts = found.join(spans.select("rid").distinct(), "rid", "left_semi")
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = texts.select("rid", F.posexplode(cuts).alias("piece", "body")).withColumn("piece", F.col("piece").cast("long"))
    body, nothing = F.col("body"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(so_far: Column, mark: Column) -> Column:
        gap = F.substr(body, (so_far["at"] + 1).cast("int"), (mark["start"] - so_far["at"]).cast("int"))
        return F.struct(mark["end"].alias("at"), F.concat(so_far["out"], gap, mark["put"]).alias("out"))

    done = F.aggregate("marks", nothing, add)
    whole = F.concat(done["out"], F.substr(body, (done["at"] + 1).cast("int")))
    pieces = pieces.join(marks, ["rid", "piece"], "left").select("rid", "piece", F.when(F.col("marks").isNull(), body).otherwise(whole).alias("out"))
    joined = pieces.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("piece", "out"))).alias("parts"))
    return joined.select("rid", F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("sanitised"))


def sanitise_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sanitised) for the rows that have personal data; other texts stay as they are."""
    return find_personal_data(docs, [key], sanitise=True).where("sanitised is not null").select(key, "sanitised")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p(kno, kind, pattern) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (4, 'key', '[A-Za-z0-9_+/-]{20,}')),
m AS (SELECT rid, 0 AS kno, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hit, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gap FROM d
  UNION ALL SELECT rid, 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM d
  UNION ALL SELECT rid, 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT rid, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT rid, 4, regexp_extract_all(text, '[A-Za-z0-9_+/-]{20,}'), string_split_regex(text, '[A-Za-z0-9_+/-]{20,}') FROM d),
x AS (SELECT rid, kno, hit, gap, unnest(range(1, len(hit) + 1)) AS i FROM m),
s AS (SELECT rid, kno, hit[i] AS h, regexp_replace(hit[i], '[^0-9]', '', 'g') AS g,
  (list_sum(list_transform(gap[1:i], lambda u: length(u))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda u: length(u))), 0))::BIGINT AS a FROM x),
base AS (SELECT rid, kno, a, a + length(h) AS z FROM s WHERE CASE kno WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(h, '.'), lambda u: length(ltrim(u, '0')) > 3 OR (length(ltrim(u, '0')) = 3 AND ltrim(u, '0') > '255'))) = 0
  WHEN 2 THEN length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(g, length(g) - j + 1, 1)::INT
      ELSE (2 * substr(g, length(g) - j + 1, 1)::INT) // 10 + (2 * substr(g, length(g) - j + 1, 1)::INT) % 10 END)) % 10 = 0
  WHEN 3 THEN length(g) BETWEEN 9 AND 15
  ELSE len(regexp_extract_all(h, '[A-Za-z][0-9]')) + len(regexp_extract_all(h, '[0-9][A-Za-z]')) >= 4 AND len(list_distinct(string_split(h, ''))) >= 10 END),
ll AS (SELECT rid, string_split(text, chr(10)) AS l FROM d),
ln AS (SELECT rid, l, unnest(range(0, len(l))) AS line FROM ll),
lo AS (SELECT rid, line, l[line + 1] AS unit, coalesce(list_sum(list_transform(l[1:line], lambda u: length(u) + 1)), 0)::BIGINT AS line_at FROM ln),
lk AS (SELECT lo.rid, line, unit, line_at, bit_or(1 << kno) AS kinds FROM lo JOIN base b ON b.rid = lo.rid AND b.a >= line_at AND b.a < line_at + length(unit) GROUP BY ALL),
wl AS (SELECT *, regexp_extract_all(unit, '\p{L}+') AS hit, string_split_regex(unit, '\p{L}+') AS gap FROM lk),
wx AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM wl),
wp AS (SELECT rid, line, unit, kinds, lower(hit[i]) AS term, length(hit[i]) AS n,
  (line_at + list_sum(list_transform(gap[1:i], lambda u: length(u))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda u: length(u))), 0))::BIGINT AS a FROM wx),
w AS (SELECT rid, line, unit, kinds, term, a, a + n AS z FROM wp WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = wp.rid AND b.a < wp.a + wp.n AND b.z > wp.a)),
ek AS (SELECT DISTINCT unit, kno, term FROM w JOIN p ON (kinds >> kno) & 1 = 1),
joint_n AS (SELECT term, kno, count(*) AS n_both FROM ek GROUP BY ALL HAVING count(*) >= 5),
raw AS (SELECT term, kno, count(*) AS n_raw FROM (SELECT DISTINCT rid, line, term, kinds FROM w) JOIN p ON (kinds >> kno) & 1 = 1 GROUP BY ALL),
tn AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(lower(unit), '[^\p{L}]+'), lambda u: u <> ''))) AS term FROM lo) GROUP BY term),
kn AS (SELECT kno, count(*) AS n_kind FROM (SELECT DISTINCT unit, kno FROM ek) GROUP BY kno),
nl AS (SELECT count(*)::DOUBLE AS n_lines FROM lo),
t AS (SELECT j.term, j.kno, n_both / (n_both + greatest(n_term - n_raw, 0)) AS within_t, n_kind / greatest(n_lines, n_kind) AS of_all
  FROM joint_n j JOIN raw USING (term, kno) JOIN tn USING (term) JOIN kn USING (kno), nl),
telling AS (SELECT term, kno, ln(within_t / of_all) / -ln(of_all) AS told FROM t WHERE of_all < 1 AND ln(within_t / of_all) / -ln(of_all) >= 0.8),
hits AS (SELECT rid, a, z, max(told) AS told FROM w JOIN telling USING (term) WHERE (kinds >> kno) & 1 = 1 GROUP BY ALL),
sp AS (SELECT rid, a, kno, z FROM base UNION ALL SELECT rid, a, 5, z FROM hits),
o AS (SELECT rid, count(*) FILTER (kno = 0) AS n_email, count(*) FILTER (kno = 1) AS n_ip, count(*) FILTER (kno = 2) AS n_card, count(*) FILTER (kno = 3) AS n_phone,
  string_agg((['email', 'ip', 'card', 'phone'])[kno + 1] || ':' || a || ':' || z, ',' ORDER BY a, kno, z) FILTER (kno < 4) AS own,
  string_agg((['email', 'ip', 'card', 'phone', 'key', 'term'])[kno + 1] || ':' || a || ':' || z, ',' ORDER BY a, kno, z) AS every,
  count(*) FILTER (kno = 4) AS n_key, count(*) FILTER (kno = 5) AS n_term, count(*) AS n_spans
  FROM sp GROUP BY rid),
mk AS (SELECT rid, a, z, (['[EMAIL]', '[IP]', '[CARD]', '[PHONE]', '[KEY]'])[kno + 1] AS put FROM base
  UNION ALL SELECT rid, a, z, CASE WHEN told >= 0.95 THEN '' ELSE '[TERM]' END FROM hits),
mo AS (SELECT *, coalesce(max(z) OVER (PARTITION BY rid ORDER BY a, z, put ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done_to FROM mk),
rd AS (SELECT rid, string_agg(substr(text, done_to + 1, a - done_to) || put, '' ORDER BY a, z, put) FILTER (a >= done_to) || substr(any_value(text), max(z) + 1) AS sanitised
  FROM mo JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_key, 0) AS n_key, coalesce(n_term, 0) AS n_term,
  coalesce(n_spans, 0) AS n_spans, sanitised
FROM d LEFT JOIN o USING (rid) LEFT JOIN rd USING (rid)
"""


@query("op2_privacy", OP2_SQL)
def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents, and the texts without it."""
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"], sanitise=True)
    names = F.array(*[F.lit(k) for k in (*PROTECTED, TERM)])
    put = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    more = F.transform(
        "terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(PROTECTED)).alias("kind"), s["end"].alias("end"))
    )
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(base, put), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(F.concat("spans", more.cast(SPAN))), put), ",").alias("spans"),
        number(len(KINDS)).alias(f"n_{KEY}"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"),
        "sanitised",
    )
