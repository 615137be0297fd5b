"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines that say the same up to `one` edit (an inserted, lost or changed character) count as repeats. A line
is split into threshold + 1 = 2 segments: one edit leaves one of them whole. Each line is indexed by its
length and either segment, and probed as a line of its own length and as the longer partner of a line one
character shorter, where the segment sits at a known place (from the left before the edit, from the right
after it). Lines that share a key are candidates; they are verified by the built-in edit distance with its
threshold, which walks a band and runs in generated code. (A bit-parallel automaton written with aggregate()
gave the same results but took some milliseconds a pair, as such functions are interpreted step by step.)

Where a key gathers more than `CROWD` lines (a heading that a thousand versions of a line begin with),
those lines are split into `FINE` segments of which all but one must be whole: the same theorem with keys
that hold nearly the whole line. So the pairs of a crowd are met only where they agree nearly everywhere.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracast.llm.storage import bucketed_by, free_name, reliable_cut

EDITS = 1
SHORTEST = 20
CROWD = 64
FINE = 16


def segment_keys(line: Column, parts: int) -> Column:
    """Array of (key, longer): all of the line but one of `parts` segments, as a line of its length and as the longer of two."""
    n = F.char_length(line)

    def keys(base: Column, longer: bool) -> Column:
        def key(i: Column) -> Column:
            start, end = F.floor(base * i / parts).cast("int"), F.floor(base * (i + 1) / parts).cast("int")
            return F.struct(F.xxhash64(F.lit(parts), i, base, F.substring(line, F.lit(1), start), F.right(line, base - end)).alias("key"), F.lit(longer).alias("longer"))

        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), key)

    return F.concat(keys(n, False), keys(n - EDITS, True))


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are at most `edits` insertions, losses or changes apart: the built-in distance walks a band of that width only."""
    return F.levenshtein(a, b, edits) >= 0


def _meet(keyed: DataFrame) -> DataFrame:
    """Pairs of lines that share a key: keyed has at, key, longer."""
    x = keyed.where("not longer").select("key", F.col("at").alias("x"))
    y = keyed.select("key", F.col("at").alias("y"), "longer")
    pairs = x.join(y, "key").where("longer or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines, n_exact, n_near (longs) of each row.

    Lines are split at line feeds and ordered by (id, row, line). A line goes if an equal line comes before
    it (n_exact), or if its first copy is within one edit of a different line that comes before that
    (n_near; both of `shortest` characters or more). Lines of blanks stay. Null ids come last; a null text
    stays null and has no lines; columns named n_lines, n_exact or n_near are replaced, others keep their
    values.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near")
    uid = free_name(docs, "uid")
    rows = bucketed_by(docs.withColumn(uid, F.monotonically_increasing_id()), uid, "numbered")
    who = rows.select(F.col(uid).alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    spread = who.select("uid", "id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.col("line").rlike("[^ \\t\\r]"))
    keys = F.when(F.char_length("line") >= shortest, segment_keys(F.col("line"), EDITS + 1))
    lines = spread.select("uid", "no", "id", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), keys.alias("keys"))
    lines = reliable_cut(lines, "lines")

    # equal lines: 128 bits of hash
    at = F.struct(F.col("id").isNull().alias("last"), "id", "uid", "no").alias("at")
    firsts = reliable_cut(lines.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")), "firsts")

    # near lines: keys that different lines share, and the first copies of those lines
    keyed = lines.select("h1", "h2", F.inline("keys"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("key")
    met = keyed.join(shared, "key", "left_semi").distinct()
    met = reliable_cut(met.join(firsts.select("h1", "h2", "at"), ["h1", "h2"]).select("at", "key", "longer"), "met")
    crowds = met.groupBy("key").agg((F.count(F.lit(1)) > CROWD).alias("crowd"))
    met = met.join(crowds, "key")
    by_row = met.select("at").distinct().select(F.col("at.uid").alias("uid"), "at")
    # split below the join: once for a document, not once for each of its lines
    texts = by_row.join(who.select("uid", F.split("text", "\n").alias("all_lines")), "uid").select("at", F.get("all_lines", F.col("at.no")).alias("line"))
    texts = reliable_cut(texts, "line-texts")
    crowded = texts.join(met.where("crowd").select("at").distinct(), "at", "left_semi")
    pairs = _meet(met.where("not crowd")).unionByName(_meet(crowded.select("at", F.inline(segment_keys(F.col("line"), FINE))))).distinct()
    pairs = pairs.join(texts.select(F.col("at").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("at").alias("b"), F.col("line").alias("line_b")), "b")
    near = pairs.where(within_edits(F.col("line_a"), F.col("line_b"))).select(F.col("b").alias("at")).distinct().withColumn("near", F.lit(True))

    # what goes, row by row
    marked = firsts.select("h1", "h2", "n", "at").join(near, "at", "left").where("n > 1 or near").select("h1", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h1", "h2", at).join(marked, ["h1", "h2"]).where("near or at != first")
    gone = gone.groupBy(F.col("at.uid").alias(uid)).agg(
        F.collect_list("at.no").alias("gone"), F.sum((F.col("at") != F.col("first")).cast("long")).alias("n_exact"), F.sum((F.col("at") == F.col("first")).cast("long")).alias("n_near"),
    )
    gone = gone.select(uid, F.struct("gone", "n_exact", "n_near").alias(free_name(rows, "cut")))
    cut = gone.columns[1]
    all_lines = free_name(rows, "all_lines")
    out = rows.withColumn(all_lines, F.split(F.col(text_col).cast("string"), "\n")).drop(text_col).join(gone, uid, "left")
    numbers = F.when(F.array_size(all_lines) > 0, F.sequence(F.lit(0), F.array_size(all_lines) - 1))
    stay = F.when(F.col(cut).isNull(), F.col(all_lines)).otherwise(F.transform(F.array_except(numbers, F.col(f"{cut}.gone")), lambda i: F.get(all_lines, i)))
    text = F.array_join(stay, "\n")
    counts = [F.coalesce(F.array_size(all_lines), F.lit(0)).cast("long").alias("n_lines"), *(F.coalesce(f"{cut}.{c}", F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near"))]
    return out.select(*[text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns], *counts)
