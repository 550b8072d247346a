"""Repeated lines by a segment-partition edit join, in DataFrame expressions only.

Lines are compared without the blanks at their ends.  Equal lines are one from the start, whatever their length; lines of
SHORTEST characters or more are also one with lines within EDITS edits (and so on from these to others):

* a line is cut into EDITS + 1 segments of even length, which are its index keys with its length and the
  segment's number; of two lines within EDITS edits one has a segment of the other unchanged;
* a line looks for the segments of lines up to EDITS shorter at those places only where the rest on either
  side can still be within the edits (multi-match-aware), as substrings of its own;
* lines that meet are confirmed by a banded bit-parallel automaton: EDITS + 1 registers of 2 * EDITS + 1
  bits hold which prefixes beside the diagonal are reached with how many edits.

Only components are asked for, so a key's lines are not paired with one another: all that look for the key are compared
with the first line that has it (its pivot).  Keys whose lines are in one component then are done, as groups of copies
are at once; the others go on with their next pivots, PIVOTS times as many in every round, against lines of other
components, until all lines that have the key were pivots.  An edit makes the number of one or two kinds of characters odd
or even, so lines that differ in more kinds than the edits can change are no pair at all.

A class of lines that occurs in two texts or more is repeated: its first occurrence (least key, then position) stays, all
others are removed.  Which texts count as one (copies, say, which a later stage drops whole) may be given; then all
lines of the text that has the first occurrence stay, in each of its copies (a null there: a text of its own).

Defined cases: null and empty texts have no lines to remove (null stays null); blank lines always stay; lines under SHORTEST
characters are compared for equality alone; a class that one text alone has stays in it, however often; repeated rows get
equal results; ties go to the least key and then the least position; an empty table gives an empty result; other columns
are kept (the results' own names are replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from consensa.llm.common import BLANKS, freed, narrowed, read, text_or_empty, written
from consensa.llm.near_dedup import components

EDITS = 2
SHORTEST = 20
#: How many times as many pivots a key has in each further round.
PIVOTS = 8
#: Tasks over which the rows of one key or pivot are split.
SALTS = 8
_BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))


def stripped(line: Column) -> Column:
    """Without the blanks at its ends; few lines have any, and trimming the others takes a while."""
    ends = reduce(lambda u, v: u | v, [line.startswith(c) | line.endswith(c) for c in _BLANKS])
    return F.when(ends, F.btrim(line, F.lit(_BLANKS))).otherwise(line)


def line_id(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def keyed(lines: DataFrame, places: list[tuple[int, int, int]], edits: int, shortest: int) -> DataFrame:
    """id and k, a row for each of the ``places`` (a length so much less, segment, shift) where ``lines`` (id, line, n) have one."""
    place = F.explode(F.array([F.struct(*[F.lit(x).alias(c) for x, c in zip(p, ("less", "i", "shift"), strict=True)]) for p in places]))
    rows = lines.select("id", "line", "n", (F.octet_length("line") == F.col("n")).alias("plain"), place.alias("p")).select(
        "id", "line", "n", "plain", (F.col("n") - F.col("p.less")).alias("other"), F.col("p.i").alias("i"), F.col("p.shift").alias("shift"))
    parts = edits + 1
    base, longer = F.floor(F.col("other") / parts).cast("int"), F.col("other") % parts
    rows = rows.withColumn("size", base + F.when(longer >= parts - F.col("i"), 1).otherwise(0)).withColumn(
        "at", base * F.col("i") + F.greatest(F.lit(0), longer - (parts - F.col("i"))) + F.col("shift"))
    key = lambda line: F.xxhash64("other", "i", F.substr(line, F.col("at") + 1, F.col("size")))
    of_bytes = key(F.col("line").cast("binary"))  # the same hash, without a walk from the line's start
    return rows.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")) & (F.col("other") >= shortest)).select(
        "id", F.when(F.col("plain"), of_bytes).otherwise(key(F.col("line"))).alias("k"))


def index_places(edits: int) -> list[tuple[int, int, int]]:
    """A line's own segments."""
    return [(0, i, 0) for i in range(edits + 1)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """Where lines of the same length or up to ``edits`` less may have a segment, but for the line's own."""
    return [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1) if less or shift]


def letters(line: Column) -> Column:
    """Of which characters (by their hash, in 64 kinds) the line has an odd number: an edit changes two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    return F.aggregate(characters(line), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)) <= 2 * edits, F.lit(True))


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``: bit i of register e is set if e edits or
    fewer turn the first ``j - edits + i`` characters of ``a`` into the first ``j`` of ``b``."""
    band = (1 << (2 * edits + 1)) - 1
    regs = [f"r{e}" for e in range(edits + 1)]
    begin = [1 << edits]
    for _ in range(edits):
        begin.append((begin[-1] | begin[-1] << 1) & band)

    def run(p: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            equal = [F.when(F.get(p, acc["j"] + (i - edits)) == c, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(2 * edits + 1)]
            x = reduce(lambda u, v: u + v, equal)

            def advanced(bits: Column) -> Column:
                new = [acc[regs[0]].bitwiseAND(bits)]
                for e in range(1, edits + 1):
                    old = acc[regs[e - 1]]
                    new.append(acc[regs[e]].bitwiseAND(bits).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
                               .bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band)))
                return F.struct((acc["j"] + 1).alias("j"), *[n.alias(r) for n, r in zip(new, regs, strict=True)])

            moved = F.element_at(F.transform(F.array(x), advanced), 1)
            return F.when(acc[regs[-1]] == 0, acc).otherwise(moved)

        zero = F.struct(F.lit(0).alias("j"), *[F.lit(v).alias(r) for v, r in zip(begin, regs, strict=True)])
        return F.aggregate(characters(b), zero, step, lambda acc: acc[regs[-1]])

    last = F.element_at(F.transform(F.array(characters(a)), run), 1)
    at = F.length(a) - F.length(b) + edits
    return F.when((at < 0) | (at > 2 * edits), F.lit(False)).otherwise(
        F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", last, F.greatest(at, F.lit(0)))) == 1)


def salted(rows: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, which has a row for each value of ``by``; equal rows are split over SALTS tasks."""
    at = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", at).join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*by, "salt"], how).drop("salt")


def confirmed(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links a, b (ids) of the pairs (pivot, id: both handles) that are within ``edits`` edits; ``texts`` has their lines."""
    text = lambda c: texts.select(F.col("h").alias(c), F.col("id").alias(f"id_{c}"), F.col("line").alias(f"of_{c}"),
                                  F.col("letters").alias(f"letters_{c}"))
    pivots = met.select("pivot").distinct()
    found = salted(met.distinct(), text("pivot").join(pivots, "pivot"), ["pivot"]).join(text("id"), "id").where("id_pivot <> id_id")
    found = found.where(may_be_near(F.col("letters_pivot"), F.col("letters_id"), edits))
    return written(found.where(within_edits(F.col("of_pivot"), F.col("of_id"), edits)).select(
        F.col("id_pivot").alias("a"), F.col("id_id").alias("b")), "line-links")


def edit_components(lines: DataFrame, edits: int, shortest: int) -> DataFrame:
    """node (id) and comp of the ``lines`` (id, line) that are within ``edits`` edits of another.  Until they are confirmed
    lines go by a handle of 64 bits; should two have the same one, both are confirmed."""
    lines = lines.select("id", "line", F.xxhash64("line").alias("h"))
    sized = lines.withColumn("n", F.length("line")).where(F.col("n") >= shortest)
    by_handle = sized.select(F.col("h").alias("id"), "line", "n")
    index = keyed(by_handle, index_places(edits), edits, shortest)
    probe = keyed(by_handle, probe_places(edits), edits, shortest)
    first = written(index.groupBy("k").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("have")), "line-first")
    several = written(first.where("have > 1"), "line-several")
    shared = written(salted(narrowed(index, several, ["k"]), several, ["k"]), "line-shared")
    met = probe.join(first.hint("shuffle_hash"), "k").unionByName(shared.select("k", "id", "pivot", "have"))  # one row a key: no sort
    met = written(met.distinct(), "line-keys")
    freed(first)
    pairs = met.where("pivot <> id").select("pivot", "id")
    wanted = written(pairs.select(F.explode(F.array("pivot", "id")).alias("h")).distinct(), "line-handles")
    texts = narrowed(lines, wanted, ["h"]).join(wanted, "h").withColumn("letters", letters(F.col("line")))
    texts = written(texts, "line-texts")  # also of all that later rounds compare
    edges = confirmed(pairs, texts, edits)
    comps = components(edges)
    # of keys with more lines than one that have them: those lines but the pivot, and whatever looks for the key
    left = shared.where("pivot <> id").select("k", "id")
    seek = met.where("have > 1").select("k", "id")
    most = 1
    while True:
        most *= PIVOTS
        of = texts.select(F.col("id").alias("node"), F.col("h").alias("id"), "letters").join(comps, "node", "left").groupBy("id").agg(
            F.min("comp").alias("comp"), F.when(F.min("letters") == F.max("letters"), F.min("letters")).alias("letters"))
        alone = lambda c: F.coalesce("comp", F.unhex(F.hex(c)))
        labelled = seek.join(of, "id", "left").withColumn("comp", alone("id"))
        open_ = labelled.groupBy("k").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("k")
        left = written(salted(left, open_, ["k"]), "line-pivots")
        nth = F.row_number().over(Window.partitionBy("k").orderBy("id"))
        now = left.withColumn("nth", nth).where(F.col("nth") <= most).select("k", F.col("id").alias("pivot"))
        now = written(now.join(of.withColumnRenamed("id", "pivot"), "pivot", "left").select(
            "k", "pivot", alone("pivot").alias("of_pivot"), F.col("letters").alias("letters_pivot")), "line-pivots-now")
        if now.limit(1).count() == 0:
            return comps
        at_once = now.groupBy("k").agg(F.collect_list(F.struct("pivot", "of_pivot", "letters_pivot")).alias("pivots"))  # at most ``most``
        others = F.filter("pivots", lambda p: (p["of_pivot"] != F.col("comp")) & (p["pivot"] != F.col("id")) & may_be_near(
            p["letters_pivot"], F.col("letters"), edits))  # so that only pairs which may be near get a row
        pairs = salted(labelled, at_once, ["k"]).select("id", F.inline(others))
        links = confirmed(pairs.select("pivot", "id"), texts, edits)
        left = left.join(now.select("k", F.col("pivot").alias("id")), ["k", "id"], "left_anti")
        if links.limit(1).count():
            edges = edges.unionByName(links)
            comps = components(edges)


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, key: str = "doc_id", text: str = "text",
                same: str | None = None) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, n_lines and n_removed.  Rows that agree in the column ``same`` are one text
    (default: each is one of its own)."""
    t = text_or_empty(f"`{text}`")
    k1, k2 = F.xxhash64(t), F.xxhash64(F.lit(1), F.col(f"`{key}`"), t)
    of_text = k2 if same is None else F.when(F.col(f"`{same}`").isNull(), k2).otherwise(F.xxhash64(F.lit(2), F.col(f"`{same}`")))
    every = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{key}`").alias("key"), of_text.alias("s"), F.posexplode(F.split(t, "\n")).alias("at", "line"))
    every = every.withColumn("line", stripped(F.col("line"))).where("line <> ''").withColumn("id", line_id(F.col("line")))
    lines = written(every.groupBy("id").agg(
        F.min("line").alias("line"), F.min(F.struct("key", "k2", "at", *([] if same is None else ["s"]))).alias("first"),
        F.min("s").alias("s1"), F.max("s").alias("s2")), "lines")
    comps = edit_components(lines.select("id", "line"), edits, shortest)
    classes = lines.drop("line").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    total = classes.groupBy("comp").agg(F.min("first").alias("first"), F.min("s1").alias("s1"), F.max("s2").alias("s2")).where("s1 <> s2")
    repeated = written(salted(classes.select("id", "comp"), total.select("comp", "first"), ["comp"]).select(
        "id", F.col("first").alias("kept")), "line-repeated")
    freed(lines)
    stays = (F.col("kept.k2") == F.col("k2")) & (F.col("kept.at") == F.col("at")) if same is None else F.col("kept.s") == F.col("s")
    marked = written(salted(narrowed(every.select("k1", "k2", "s", "at", "id"), repeated, ["id"]), repeated, ["id"]).where(~stays).groupBy("k1", "k2").agg(
        F.collect_set("at").alias("__gone")), "lines-gone")  # of one document
    freed(repeated)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = docs.select(*names, k1.alias("k1"), k2.alias("k2")).join(marked, ["k1", "k2"], "left")
    parts = F.split(t, "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone")), lambda i: F.get("__parts", i))
    cut = F.col("__gone").isNotNull()
    out = found.withColumn("__parts", parts).withColumn("n_lines", F.size("__parts")).withColumn(
        "n_removed", F.when(cut, F.size("__gone")).otherwise(0)).withColumn(
        text, F.when(cut, F.array_join(rest, "\n")).otherwise(F.col(f"`{text}`")))
    return out.drop("k1", "k2", "__gone", "__parts")


def q_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty().cast("binary"), 256).alias("text_sha256"))


_STRIP = f"regexp_replace(x, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"
DEDUP_SQL = f"""
    occ AS (SELECT doc_id, text, i - 1 AS pos, string_split(text, chr(10))[i] AS x,
                   {_STRIP.replace('x,', 'string_split(text, chr(10))[i],', 1)} AS line
            FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
                  FROM documents)),
    lines AS (SELECT line, min(doc_id) AS d1, max(doc_id) AS d2, min(doc_id * 1048576 + pos) AS head
              FROM occ WHERE line <> '' GROUP BY line),
    links AS (SELECT a.line AS a, b.line AS b FROM lines a JOIN lines b
              ON length(b.line) BETWEEN length(a.line) - {EDITS} AND length(a.line) + {EDITS} AND a.line <> b.line
              WHERE length(a.line) >= {SHORTEST} AND length(b.line) >= {SHORTEST} AND levenshtein(a.line, b.line) <= {EDITS}),
    reach(a, b) AS (SELECT line, line FROM lines UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    comp AS (SELECT a AS line, min(b) AS comp FROM reach GROUP BY a),
    class AS (SELECT comp, min(d1) < max(d2) AS repeated, min(head) AS head FROM lines JOIN comp USING (line) GROUP BY comp),
    judged AS (SELECT occ.*, coalesce(class.repeated AND NOT (class.head = doc_id * 1048576 + occ.pos), false) AS gone
               FROM occ LEFT JOIN comp ON occ.line = comp.line LEFT JOIN class ON comp.comp = class.comp)"""

QUERIES = {"op3_line_dedup": q_line_dedup}
ORACLE = {"op3_line_dedup": f"""
    WITH RECURSIVE {DEDUP_SQL}
    SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
           sha256(coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
    FROM judged GROUP BY doc_id"""}
