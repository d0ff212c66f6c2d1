"""Personal data in texts, in DataFrame operations only: regular expressions propose spans,
checksum validators confirm them, context words nearby adjust their score.

One projection over the texts, without a shuffle.  Proposals of a kind are cut out of a text
twice with one pattern, as matches and as the gaps between them, so the lengths of both give
every match's place in code points.  Patterns start only where a run of their characters
starts and give nothing back, so they stay linear on texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, table

#: Kinds in their order: the first four are the base, the others are added.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = 4

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9 -])[0-9 -]{14,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # Keys and tokens: long runs of letters and digits, told from words by context.
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
#: Texts in which a kind cannot occur are told by a cheaper test.
HINTS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][0-9 -]{12}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "secret": r"[A-Za-z0-9+/_=-]{20}",
}
#: The score of a confirmed span, and what a context word adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT_SCORE = 0.3
#: Added kinds need this score; base spans stay whatever theirs.
LEAST_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT = {
    "email": r"mail|contact|write|schreib|escrib|courriel",
    "ip": r"\bip\b|address|server|host|adresse|login",
    "card": r"card|credit|visa|payment|karte|carte|tarjeta",
    "phone": r"phone|call|tel|fax|mobile|contact|handy|movil",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
    "secret": r"token|secret|passw|key|credential|bearer",
}
#: Lengths are summed in blocks of this many.
BLOCK = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.char_length(digits) - 1)
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes its check (ISO 7064, 97-10)."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a proposed match is one of its kind."""
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.char_length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$")
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _isolated(text: Column) -> Column:
    """The text with separators that do not stand alone between digits put out of the way,
    one character for one."""
    return F.regexp_replace(text, r"[ -](?![0-9])|(?<![0-9])[ -]", "\n")


def _cut(df: DataFrame, kind: str) -> DataFrame:
    """Adds the matches, gaps and lengths of a kind; null where the text cannot have any."""
    can = F.col("__text").contains("@") if kind == "email" else F.col("__text").rlike(HINTS[kind])
    source = _isolated(F.col("__text")) if kind == "card" else F.col("__text")
    df = df.withColumn(f"__m_{kind}", F.when(can, F.regexp_extract_all(source, F.lit(PATTERNS[kind]), F.lit(0))))
    found = F.size(f"__m_{kind}") > 0
    return df.withColumn(f"__g_{kind}", F.when(found, F.split(source, PATTERNS[kind])))


def _sums(df: DataFrame, kind: str) -> DataFrame:
    """Adds, for each match, the length of its gap and itself, and sums over whole blocks."""
    pair = F.zip_with(
        F.slice(f"__g_{kind}", 1, F.size(f"__m_{kind}")), f"__m_{kind}", lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long")
    )
    df = df.withColumn(f"__l_{kind}", F.when(F.col(f"__g_{kind}").isNotNull(), pair))
    blocks = F.sequence(F.lit(0), F.floor((F.size(f"__l_{kind}") - 1) / BLOCK).cast("int"))
    total = F.transform(
        blocks, lambda b: F.aggregate(F.slice(f"__l_{kind}", b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda a, x: a + x)
    )
    return df.withColumn(f"__b_{kind}", F.when(F.col(f"__l_{kind}").isNotNull(), total))


def _spans(kind: str) -> Column:
    """The confirmed spans of a kind as structs (start, rank, end, kind, score)."""
    zero = F.lit(0).cast("long")

    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        whole = F.aggregate(F.slice(f"__b_{kind}", F.lit(1), block), zero, lambda a, x: a + x)
        part = F.aggregate(F.slice(f"__l_{kind}", block * BLOCK + 1, i % BLOCK + 1), zero, lambda a, x: a + x)
        end = whole + part
        near = F.concat_ws(
            " ",
            F.right(F.get(f"__g_{kind}", i), F.lit(CONTEXT_CHARS)),
            F.left(F.get(f"__g_{kind}", i + 1), F.lit(CONTEXT_CHARS)),
        )
        score = F.lit(SCORES[kind]) + F.when(near.rlike("(?i)" + CONTEXT[kind]), F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        return F.struct(
            (end - F.char_length(match)).alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
            confirmed(kind, match).alias("ok"),
        )

    found = F.filter(F.transform(f"__m_{kind}", span), lambda s: s["ok"])
    if kind in KINDS[BASE:]:
        found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,ok:boolean>>")
    return F.coalesce(F.when(F.col(f"__l_{kind}").isNotNull(), found), empty)


def detect(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (all by default) and ``pii``: an array of (start, rank, end, kind,
    score, ok) in the order of start and kind; code points, end exclusive.

    Null and empty texts have none.  Every row is judged by itself, so repeated rows, null
    ids and empty tables need no rule; a column named ``pii`` is replaced, others pass through
    whatever they are called.
    """
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() != "pii"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], as_text(text_col).alias("__text"))
    for step in (_cut, _sums):
        for kind in KINDS:
            rows = step(rows, kind)
    spans = F.array_sort(F.flatten(F.array(*[_spans(kind) for kind in KINDS])))
    # Named only once the spans are made: a new name in one list could stand for an inner column.
    made = rows.select(*[f"c{i}" for i in range(len(keep))], spans.alias("pii"))
    return made.toDF(*keep, "pii")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = detect(table(spark, sf_dir, "documents"), columns=["doc_id"])

    def many(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["rank"] < BASE)
    return found.select(
        "doc_id",
        *[many(kind) for kind in KINDS[:BASE]],
        F.size("pii").cast("long").alias("n_spans"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
    )


def op7_sql() -> str:
    """The same for DuckDB, whose patterns look neither ahead nor behind: where a kind must
    stand free of its neighbours, runs of their characters are put between two marks first."""
    free = "chr(1) || '\\1' || chr(2)"
    # (pattern, characters of the runs between marks, whether a match is confirmed)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", None, "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", None, "list_bool_and([coalesce(try_cast(p AS INTEGER) <= 255, false) for p in string_split(m, '.')])"),
        "card": (
            r"[0-9](?:[ -]?[0-9])+",
            None,
            """length(d) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INTEGER
            ELSE substr('0246813579', substr(d, length(d) - i, 1)::INTEGER + 1, 1)::INTEGER END for i in range(length(d))]) % 10 = 0""",
        ),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", None, "length(d) BETWEEN 10 AND 15"),
        "iban": (
            r"\x01[A-Z]{2}[0-9]{2}(?:(?:\x02 \x01)?[A-Z0-9]{4}){2,7}(?:(?:\x02 \x01)?[A-Z0-9]{1,3})?\x02",
            "A-Za-z0-9",
            f"""length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_sum([substr(v, length(v) - i, 1)::INTEGER * {[pow(10, k, 97) for k in range(2 * 34)]}[i + 1]
            for i in range(length(v))]) % 97 = 1""",
        ),
        "ssn": (
            r"\x01[0-9]{3}-[0-9]{2}-[0-9]{4}\x02",
            "0-9-",
            f"""NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, '{CONTEXT["ssn"]}')""",
        ),
        "secret": (
            r"\x01[A-Za-z0-9+/_=-]{20,}\x02",
            "A-Za-z0-9+/_=-",
            f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND regexp_matches(near, '{CONTEXT['secret']}')",
        ),
    }
    parts, confirmed = [], []
    for rank, (kind, (pattern, run, ok)) in enumerate(kinds.items()):
        text = f"regexp_replace(t, '([{run}]+)', {free}, 'g')" if run else "t"
        parts.append(f"SELECT r, {rank} AS rank, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM docs")
        confirmed.append(f"WHEN {rank} THEN {ok}")
    bare = "translate({}, chr(1) || chr(2), '')"
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    many = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{kind}" for i, kind in enumerate(KINDS[:BASE]))
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '..') AS t FROM documents),
        cut AS ({" UNION ALL ".join(parts)}),
        one AS (SELECT r, rank, i, {bare.format("ms[i]")} AS m, {bare.format("gs[i]")} AS g, {bare.format("gs[i + 1]")} AS after
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut WHERE len(ms) > 0)),
        placed AS (SELECT r, rank, m, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i)::BIGINT AS stop,
            regexp_replace(m, '[^0-9]', '', 'g') AS d,
            translate(right(g, {CONTEXT_CHARS}) || ' ' || left(after, {CONTEXT_CHARS}), '{capital}', '{small}') AS near,
            CASE WHEN rank = {KINDS.index("iban")} THEN array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END
                for c in string_split(substr(replace(m, ' ', ''), 5) || left(m, 4), '')], '') END AS v
            FROM one),
        spans AS (SELECT r, rank, stop - length(m) AS start, {list(KINDS)}[rank + 1] || ':' || (stop - length(m)) || ':' || stop AS s
            FROM placed WHERE CASE rank {" ".join(confirmed)} END),
        joined AS (SELECT r, {many}, count(*) AS n_spans,
            string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {BASE}) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
            FROM spans GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS[:BASE])}, coalesce(n_spans, 0) AS n_spans,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN joined USING (r)"""
