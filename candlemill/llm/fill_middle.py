"""Fill-in-middle transformation over relational units.

A text is a sequence of units: runs of A-Z and a-z, and every other code point by itself. Two cuts, by unit, part it
into prefix, middle and suffix. Texts are cut into pieces of PIECE code points (long texts into PIECES pieces); the
number of units that begin in each piece tells which piece holds the unit that ends a part. The matches of these
pieces alone are posexploded; window running sums of their lengths give where each unit ends; the cut requests meet
the units by ordinal; offsets are aggregated for each document; and substrings of the text, which is shuffled once,
make the output. A text's work is spread over its pieces, so no window holds more than a piece.

Which form a document gets and where it is cut depends on its id alone (and its number of units), through SHA-256.
Rows that repeat an id and its text are worked on once and meet the result in a plain join, which adaptive execution
splits where they are many.

Null text: as empty. Empty texts, and those that hold a mark, stay plain. Null id: hashed as no digits. Ids of any
type: hashed by their text. Texts may be of any length. Repeated rows each get the same result. Ties (equal cuts):
an empty middle. Empty table: no rows. Extra columns stay; those that have a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, prepare, settled

#: Units, marks, shares in hundredths.
UNIT, RUN = "[A-Za-z]+|[^A-Za-z]", "[A-Za-z]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_SHARE, SPM_SHARE = 90, 20
#: Code points of a piece at least, and pieces of a text at most.
PIECE, PIECES = 512, 64
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def n_units(text: Column) -> Column:
    """Units of a text: its code points, each run of letters as one."""
    return F.char_length(F.regexp_replace(text, RUN, "a")).cast("long")


def draws(doc: Column) -> list[Column]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    return F.when((text == "") | marked | (h3 % 100 >= FIM_SHARE), "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")


def content(doc: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    own = F.coalesce(doc.cast("string"), F.lit(""))
    return [F.xxhash64(own, text).alias("_k1"), F.xxhash64(text, F.lit(11), own).alias("_k2")]


def pieces_to_cut(rows: DataFrame) -> DataFrame:
    """For each row that is cut, the pieces that hold the unit before a cut: its lengths of units, and the requests.

    Each piece is taken with the code point before it (a dot before the first), so its first unit is the last one that
    began before the piece, ends at or after the border, and has that one code point too many.
    """
    size = F.greatest(F.lit(PIECE), F.ceil(F.char_length("_text") / PIECES).cast("int"))
    begin = lambda i: (i * F.col("_size")).cast("int")
    piece = lambda i: F.substring("_dotted", begin(i) + 1, F.col("_size") + 1)
    dotted = rows.select("_k1", "_k2", "_h1", "_h2", size.alias("_size"), F.concat(F.lit("."), "_text").alias("_dotted"))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.char_length("_dotted") - 1) / F.col("_size")).cast("int") - 1))
    begun = dotted.withColumn("_begun", F.transform(numbers, lambda i: n_units(piece(i)) - 1))
    before = F.aggregate("_begun", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    placed = begun.withColumn("_before", before).withColumn("_n", F.element_at("_before", -1))
    h1, h2 = F.col("_h1") % (F.col("_n") + 1), F.col("_h2") % (F.col("_n") + 1)
    cuts = F.array(F.struct(F.lit("prefix").alias("part"), F.least(h1, h2).alias("unit")), F.struct(F.lit("middle").alias("part"), F.greatest(h1, h2).alias("unit")))
    held = lambda i: lambda c: (c["unit"] > 0) & (c["unit"] >= F.element_at("_before", i + 1)) & (c["unit"] <= F.element_at("_before", i + 2))
    placed = placed.withColumn("_cuts", cuts)
    wanted = placed.withColumn("piece", F.explode(F.filter(F.sequence(F.lit(0), F.size("_begun") - 1), lambda i: F.exists("_cuts", held(i)))))
    wanted = wanted.withColumn("requests", F.filter("_cuts", held(F.col("piece")))).withColumn("first", F.element_at("_before", F.col("piece") + 1))
    most = F.array_max(F.transform("requests", lambda c: c["unit"])) - F.col("first") + 1
    lengths = F.transform(F.regexp_extract_all(piece(F.col("piece")), F.lit(UNIT), F.lit(0)), lambda x: F.char_length(x))
    return wanted.select("_k1", "_k2", "piece", "requests", "first", F.slice(lengths, F.lit(1), most.cast("int")).alias("lengths"), (begin(F.col("piece")).cast("long") - 1).alias("chars_before"))


def offsets(rows: DataFrame) -> DataFrame:
    """Code points before each cut, for each content that is cut: n, prefix_end, middle_end."""
    cut = settled(pieces_to_cut(rows))
    # contents that repeat meet before the shuffle
    once = cut.select("_k1", "_k2", "piece", "lengths", "first", "chars_before").dropDuplicates(["_k1", "_k2", "piece"])
    units = once.select("_k1", "_k2", "piece", "first", "chars_before", F.posexplode("lengths").alias("at", "length"))
    ends = F.sum("length").over(Window.partitionBy("_k1", "_k2", "piece").orderBy("at"))
    units = units.select("_k1", "_k2", "piece", (F.col("first") + F.col("at")).alias("ordinal"), (F.col("chars_before") + ends).alias("end"))
    requests = cut.select("_k1", "_k2", "piece", F.explode("requests").alias("c")).select("_k1", "_k2", "piece", F.col("c.part").alias("part"), F.col("c.unit").alias("unit")).distinct()
    # the units stay where they are: they are partitioned by piece, and ordinals are compared within it
    met = units.join(requests, ["_k1", "_k2", "piece"]).filter((F.col("ordinal") - F.col("unit")) == 0)
    part = lambda x: F.max(F.when(F.col("part") == x, F.col("end"))).alias(f"{x}_end")
    return met.groupBy("_k1", "_k2").agg(part("prefix"), part("middle"))


def transform(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output to each row."""
    prepare(documents.sparkSession)
    inner, columns = aside(documents, text, RESULTS, keep_text=True, _doc=doc)
    inner = inner.withColumn("_text", F.coalesce("_text", F.lit("")))
    h = draws(F.col("_doc"))
    rows = inner.select("*", *content(F.col("_doc"), F.col("_text")), form_of(F.col("_text"), h[2], h[3]).alias("form"))
    chosen = rows.filter("form <> 'plain'").select("_k1", "_k2", "_text", h[0].alias("_h1"), h[1].alias("_h2"))
    out = rows.join(offsets(chosen), ["_k1", "_k2"], "left")
    start, end = F.coalesce("prefix_end", F.lit(0)).cast("int"), F.coalesce("middle_end", F.lit(0)).cast("int")
    out = out.withColumn("_start", start).withColumn("_length", end - start)
    prefix, middle, suffix = F.substring("_text", F.lit(1), F.col("_start")), F.substring("_text", F.col("_start") + 1, F.col("_length")), F.substring("_text", F.col("_start") + F.col("_length") + 1, F.char_length("_text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    is_plain = F.col("form") == "plain"
    return out.select(
        *columns,
        n_units(F.col("_text")).alias("n"),
        "form",
        F.when(~is_plain, F.col("_start").cast("long")).alias("prefix_chars"),
        F.when(~is_plain, F.col("_length").cast("long")).alias("middle_chars"),
        F.when(is_plain, F.col("_text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a mark, so the marks part it in four."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    at = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "plain", output).when(form == "psm", at(2, 4, 3)).otherwise(at(3, 4, 2))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents
), h AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM h
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
