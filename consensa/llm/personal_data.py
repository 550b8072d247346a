"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything is a DataFrame expression over one row, so there is no shuffle.  Of a kind's expression, the matches and the
text between them (a split by the same expression) give every proposal its place: its start is the sum of what lies before,
taken as sums of blocks as wide as the root of the count, so that a text with very many proposals stays cheap.  What lies
between a proposal and its neighbours also gives its context: up to BEFORE characters in front and AFTER behind it.

A proposal starts with the points of its kind, earns more by its checksum (Luhn for cards, mod 97 for account numbers) and
by words of its kind beside it, and loses some by words that name other things (a version, an order, a serial number).  It
is a span with THRESHOLD points or more.  The base kinds are spans whenever their own check holds, whatever the context:

* email; ip (four numbers of at most 255); card (16 to 19 digits, Luhn); phone (+, 8 to 15 digits);

the others need their points:

* short_card (13 to 15 digits; Luhn and a word), iban (mod 97), ssn (valid number ranges and a word), local_phone
  (three, three and four digits; brackets or a word).

The expressions are those of the kinds made linear: a run that cannot match is skipped whole (possessive, and with no start
inside it), which changes no match.

Defined cases: null and empty texts have no spans; places count code points, ends are exclusive; spans of one kind never
overlap, of different kinds they may; a failing match is not tried again from a later start; repeated rows get equal
results; an empty table gives an empty result; other columns are kept (the results' own names are replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from consensa.llm.common import read, text_or_empty

THRESHOLD = 50
#: Characters of context in front of and behind a proposal.
BEFORE, AFTER = 40, 20
#: Points lost beside a word that names something else.
OTHER = 20
OTHER_WORDS = ["version", "isbn", "issn", "order", "serial", "invoice", "ticket", "build", "revision"]
_EMPTY = "array<struct<kind:string,start:int,end:int,score:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letters(words: list[str]) -> str:
    return f"(^|[^a-z])({'|'.join(words)})($|[^a-z])"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn sum."""
    def points(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), points), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (A-Z and 0-9) has the right remainder with its first four characters moved to the end."""
    def value(i: Column) -> Column:
        c = F.substring(account, F.when(i <= F.length(account) - 4, i + 4).otherwise(i - F.length(account) + 4), F.lit(1))
        return F.ascii(c)
    step = lambda a, c: F.when(c >= 65, a * 100 + c - 55).otherwise(a * 10 + c - 48) % 97
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(account)), value), F.lit(0), step) == 1


def located(text: Column, pattern: str) -> Column:
    """Array of (value, start, end, before, after) of the matches of an expression that never matches nothing."""
    def place(p: Column) -> Column:
        def step(m: Column, i: Column) -> Column:
            gap = F.length(F.get(p["g"], i))
            return F.struct(gap.alias("gap"), (gap + F.length(m)).alias("all"))
        return let(F.transform(p["m"], step), lambda s: in_blocks(p, s))

    def in_blocks(p: Column, s: Column) -> Column:
        n = F.size(s)
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["all"])
        width = F.ceil(F.sqrt(n)).cast("int")

        def with_width(w: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), n - 1, w), lambda b: total(F.slice(s, b + 1, w)))
            before = lambda sums: F.transform(sums, lambda _, k: F.aggregate(
                F.slice(sums, F.lit(1), k), F.lit(0), lambda a, x: a + x))
            return let(let(sums, before), lambda block: F.transform(p["m"], lambda m, i: one(m, i, w, block)))

        def one(m: Column, i: Column, w: Column, block: Column) -> Column:
            at = (i - i % w).cast("int")
            start = F.get(block, F.floor(i / w).cast("int")) + total(F.slice(s, at + 1, i % w)) + F.get(s, i)["gap"]
            gap, rest = F.get(p["g"], i), F.get(p["g"], i + 1)
            return F.struct(
                m.alias("value"), start.alias("start"), (start + F.length(m)).alias("end"),
                F.when((gap == "") & (i > 0), F.lit("0")).otherwise(F.substring(gap, F.greatest(F.lit(1), F.length(gap) - BEFORE + 1), F.lit(BEFORE))).alias("before"),
                F.when((rest == "") & (i < n - 1), F.lit("0")).otherwise(F.substring(rest, 1, AFTER)).alias("after"))

        return let(width, with_width)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(found, place)


@dataclass(frozen=True)
class Kind:
    """``points(proposal)`` is null where the kind's own check fails."""
    name: str
    points: Callable[[Column], Column]
    words: list[str]
    word_points: int
    base: bool = False


def alone(p: Column, front: str = "0-9A-Za-z", behind: str = "0-9A-Za-z") -> Column:
    """No such character touches the proposal."""
    return ~p["before"].rlike(f"[{front}]$") & ~p["after"].rlike(f"^[{behind}]")


_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: An expression, and the kinds of what it proposes, in the order of the results.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
LOCAL = r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
CARD_WORDS = ["card", "credit", "debit", "visa", "mastercard", "amex", "payment"]
PHONE_WORDS = ["phone", "telephone", "tel", "mobile", "cell", "call", "fax", "whatsapp"]


def _card(least: int, most: int, points: int) -> Callable[[Column], Column]:
    return lambda p: let(digits_of(p["value"]), lambda d: F.when(F.length(d).between(least, most), F.when(luhn(d), F.lit(points))))


def _phone(p: Column) -> Column:
    return F.when(F.length(digits_of(p["value"])).between(8, 15), F.lit(55))


def _iban(p: Column) -> Column:
    plain = F.replace(p["value"], F.lit(" "), F.lit(""))
    return F.when(alone(p), let(plain, lambda v: F.when(F.length(v).between(15, 34), F.when(mod97(v), F.lit(60)).otherwise(20))))


def _ssn(p: Column) -> Column:
    wrong = p["value"].rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(alone(p, "0-9A-Za-z+.-", "0-9A-Za-z-") & ~wrong, F.lit(25))


def _local(p: Column) -> Column:
    whole = alone(p, "0-9A-Za-z+(.-", "0-9A-Za-z-") & ~p["before"].rlike(r"[0-9+][\x20.-]$")
    return F.when(whole, F.when(p["value"].startswith("("), F.lit(55)).otherwise(40))


KINDS: list[tuple[str, list[Kind]]] = [
    (EMAIL, [Kind("email", lambda p: F.lit(60), ["mail", "email", "contact", "write"], 20, True)]),
    (IP, [Kind("ip", lambda p: F.when(p["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), F.lit(60)), ["ip", "address", "host", "server"], 20, True)]),
    (DIGITS, [Kind("card", _card(16, 19, 80), CARD_WORDS, 20, True)]),
    (PHONE, [Kind("phone", _phone, PHONE_WORDS, 20, True)]),
    (DIGITS, [Kind("short_card", _card(13, 15, 30), CARD_WORDS, 30)]),
    (IBAN, [Kind("iban", _iban, ["iban", "account", "bank", "konto", "compte", "cuenta"], 20)]),
    (SSN, [Kind("ssn", _ssn, ["ssn", "social", "security", "taxpayer"], 40)]),
    (LOCAL, [Kind("local_phone", _local, PHONE_WORDS, 20)]),
]
BASE = [k.name for _, kinds in KINDS for k in kinds if k.base]


def _spans(text: Column, pattern: str, kinds: list[Kind]) -> Column:
    """Array of (kind, start, end, score) of an expression's kinds."""
    def judged(p: Column, kind: Kind) -> Column:
        near = F.lower(F.concat(p["before"], F.lit(" "), p["after"]))
        adjust = F.when(near.rlike(letters(kind.words)), F.lit(kind.word_points)).otherwise(0) - F.when(
            near.rlike(letters(OTHER_WORDS)), F.lit(OTHER)).otherwise(0)
        least = F.lit(THRESHOLD if kind.base else 0)
        score = let(kind.points(p) + adjust, lambda s: F.when(s.isNotNull(), F.least(F.greatest(s, least), F.lit(100))))
        return F.struct(F.lit(kind.name).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), score.alias("score"))

    of = lambda found, kind: F.filter(F.transform(found, lambda p: judged(p, kind)), lambda s: s["score"] >= THRESHOLD)
    every = lambda found: F.concat(*[of(found, kind) for kind in kinds])
    return F.when(text.rlike(pattern), let(located(text, pattern), every)).otherwise(F.array().cast(_EMPTY))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, score), by kind and then start."""
    t = text_or_empty(f"`{text}`")
    return docs.withColumn("spans", F.concat(*[_spans(t, pattern, kinds) for pattern, kinds in KINDS]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def q_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


_WORDS = lambda words: letters(words).replace("'", "''")
_DIGITS_SQL = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN_SQL = f"""(list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN CAST({_DIGITS_SQL}[-k] AS INT)
         WHEN CAST({_DIGITS_SQL}[-k] AS INT) > 4 THEN 2 * CAST({_DIGITS_SQL}[-k] AS INT) - 9
         ELSE 2 * CAST({_DIGITS_SQL}[-k] AS INT) END)) % 10 = 0)"""
_PLAIN_SQL = "replace(value, ' ', '')"
_MOD97_SQL = f"""(list_reduce(list_transform(string_split(array_to_string(list_transform(
    string_split({_PLAIN_SQL}[5:] || {_PLAIN_SQL}[1:4], ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''), lambda c: CAST(c AS INT)),
    lambda a, b: (a * 10 + b) % 97) = 1)"""
_ALONE_SQL = lambda a, b: f"NOT regexp_matches(before, '[{a}]$') AND NOT regexp_matches(after, '^[{b}]')"
#: Of each kind: its expression as stated, and its points.
_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "60"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "CASE WHEN list_max(list_transform(string_split(value, '.'), lambda v: TRY_CAST(v AS HUGEINT))) <= 255 THEN 60 END"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS_SQL}) BETWEEN 16 AND 19 AND {_LUHN_SQL} THEN 80 END"),
    "phone": (PHONE, f"CASE WHEN length({_DIGITS_SQL}) BETWEEN 8 AND 15 THEN 55 END"),
    "short_card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS_SQL}) BETWEEN 13 AND 15 AND {_LUHN_SQL} THEN 30 END"),
    "iban": (IBAN, f"CASE WHEN {_ALONE_SQL('0-9A-Za-z', '0-9A-Za-z')} AND length({_PLAIN_SQL}) BETWEEN 15 AND 34 "
                   f"THEN CASE WHEN {_MOD97_SQL} THEN 60 ELSE 20 END END"),
    "ssn": (SSN, f"CASE WHEN {_ALONE_SQL('0-9A-Za-z+.-', '0-9A-Za-z-')} AND NOT regexp_matches(value, '^(?:000|666|9)|-00-|-0000$') THEN 25 END"),
    "local_phone": (LOCAL, f"CASE WHEN {_ALONE_SQL('0-9A-Za-z+(.-', '0-9A-Za-z-')} AND NOT regexp_matches(before, '[0-9+][\\x20.-]$') "
                           "THEN CASE WHEN value[1] = '(' THEN 55 ELSE 40 END END"),
}


def _kind_sql(at: int, kind: Kind) -> str:
    pattern, points = _SQL[kind.name]
    near = "(' ' || lower(before || ' ' || after) || ' ')"
    return f"""
    SELECT doc_id, {at} AS rank, '{kind.name}' AS kind, start, start + length(value) AS "end" FROM (
      SELECT *, {points} + CASE WHEN regexp_matches({near}, '{_WORDS(kind.words)}') THEN {kind.word_points} ELSE 0 END
             - CASE WHEN regexp_matches({near}, '{_WORDS(OTHER_WORDS)}') THEN {OTHER} ELSE 0 END AS score
      FROM (SELECT doc_id, m[i] AS value, coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0)
                   + list_sum(list_transform(g[1:i], lambda v: length(v))) AS start,
                   CASE WHEN g[i] = '' AND i > 1 THEN '0' ELSE right(g[i], {BEFORE}) END AS before,
                   CASE WHEN g[i + 1] = '' AND i < len(m) THEN '0' ELSE left(g[i + 1], {AFTER}) END AS after
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
              SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g
              FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))))) WHERE score {'IS NOT NULL' if kind.base else f'>= {THRESHOLD}'}"""


_ALL_KINDS = [k for _, kinds in KINDS for k in kinds]
QUERIES = {"op12_personal_data": q_personal_data}
ORACLE = {"op12_personal_data": f"""
    WITH spans AS ({' UNION ALL '.join(_kind_sql(i, k) for i, k in enumerate(_ALL_KINDS))}),
    text_of AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || "end" AS s FROM spans)
    SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
           sha256(coalesce(string_agg(s, ',' ORDER BY rank, start) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
           coalesce(string_agg(s, ',' ORDER BY rank, start), '') AS spans
    FROM documents d LEFT JOIN text_of t ON d.doc_id = t.doc_id GROUP BY d.doc_id"""}
