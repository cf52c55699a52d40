"""Quality rules as a bitmask ledger.

Every rule is measured once. The ledger keeps the measurements and one bit for each rule
that a document fails. A policy is a version with the mask of the rules it enforces, so a verdict is
one bitwise and; what each rule alone costs is computed from the counts per mask, of which
there are at most two to the number of rules.

The ledger is written once; the verdicts and ablations of all versions are read from it. SQL
fixes the columns of the query, so it returns the verdicts of the base and the current version.
Everything is a built-in expression on one row: no Python, and no shuffle but that of the
counts per mask. Windows of words are compared by the 64-bit hashes of their words' hashes.

Defined results: a null text has no words, like an empty one, and fails ``few_words``. A
line is what stands between newlines; only lines with a word count. Repeated rows are judged
each for themselves. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import materialize, table

WINDOW = 5


class Rule(NamedTuple):
    name: str
    fails: str  # SQL over the measurements


#: A rule's bit is its place: append only.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("shouting", "word_chars >= 40 and 10 * n_upper > 6 * word_chars"),
)


class Policy(NamedTuple):
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("1", (*BASE.rules, "symbols", "repeated_lines")), Policy("2", tuple(r.name for r in RULES)))
CURRENT = POLICIES[-1]


def with_repeated_words(rows: DataFrame, n: int = WINDOW) -> DataFrame:
    """Adds n_repeat_words: how many words lie in windows of ``n`` that stand twice or more.

    ``rows`` has ``hashes``, those of the words in order. Windows are sorted by (hash, place);
    those with an equal neighbour are found twice; their places, in order, cover ``n`` words
    each less what the next one covers too. Each array is a column of its own, so that it is
    made once a row and not once an element; texts without a repeat stop at the first.
    """
    at = F.sequence(F.lit(1), F.size("hashes") - (n - 1))
    hashes, windows, placed, places = (F.col(f"__{x}") for x in ("hashes", "windows", "placed", "places"))
    equal = lambda k, x: F.get(placed, k)["h"] == x["h"]
    covered = F.aggregate(
        places,
        F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).alias("n")),
    )
    return (
        rows.withColumn("__hashes", F.col("hashes"))
        .withColumn("__windows", F.when(F.size("hashes") > n, F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i - 1 + k) for k in range(n))))))
        .withColumn("__repeats", F.size(F.array_distinct(windows)) < F.size(windows))
        .withColumn("__placed", F.when(F.col("__repeats"), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("__places", F.filter(F.transform(placed, lambda x, k: F.when(equal(k - 1, x) | equal(k + 1, x), x["i"])), lambda i: i.isNotNull()))
        .withColumn("__places", F.sort_array(places))
        .withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0).cast("long")))
        .drop("__hashes", "__windows", "__repeats", "__placed", "__places")
    )


def measured(documents: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and
    n_repeat_words, each over the whole text."""
    gone = lambda signs: (F.length("text") - F.length(F.regexp_replace("text", signs, ""))).cast("long")
    words = F.filter(F.split("text", "[ \t-\r]+", -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^ \t-\r]"))
    texts = documents.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = (
        texts.select("doc_id", gone("[#*$%&|<>]").alias("n_symbols"), gone("[A-Z]").alias("n_upper"), words.alias("words"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            "n_symbols",
            "n_upper",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        )
    )
    return with_repeated_words(rows).drop("hashes")


def ledger(documents: DataFrame) -> DataFrame:
    """The measurements with ``failed``: bit i is set where rule i fails."""
    bits = [F.expr(f"case when {r.fails} then {1 << i}L else 0L end") for i, r in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(documents).withColumn("failed", failed)


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def verdicts(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger's rows with ``kept_<version>`` for each policy."""
    return rows.select("*", *(passes(p).alias(f"kept_{p.version}") for p in policies))


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each version and rule: documents kept, and kept if that rule were left out."""
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    kept = lambda mask: F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.lit(mask)) == 0, F.col("n"))), F.lit(0))
    plan = [(p, r, 1 << i) for p in policies for i, r in enumerate(RULES) if r.name in p.rules]
    each = [
        F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), kept(p.mask).alias("kept"), kept(p.mask & ~bit).alias("kept_without"))
        for p, r, bit in plan
    ]
    return masks.agg(F.array(*each).alias("each")).select(F.inline("each"))


def judged(documents: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> tuple[DataFrame, DataFrame]:
    """Verdicts and ablations of all versions, both from one ledger that is written once."""
    rows = materialize(ledger(documents), "ledger")
    return verdicts(rows, policies), materialize(ablations(rows, policies), "ablations")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document under the current policy. The ledger and
    the ablations of every version stay in the shared folder."""
    rows, _ = judged(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col(f"kept_{BASE.version}")).alias("base_failed"),
        F.col(f"kept_{CURRENT.version}").alias("kept"),
        "failed",
    )


OP6_SQL = """
with texts as (select doc_id, coalesce(text, '') as text from documents),
parts as (
  select doc_id, text,
    list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as l
  from texts),
base as (
  select doc_id, w, l, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines
  from parts),
windows as (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as t
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from base where len(w) >= 5)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, t) > 1),
again as (
  select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by doc_id),
measured as (select base.*, coalesce(n_repeat_words, 0) as n_repeat_words from base left join again using (doc_id)),
bits as (
  select *, n_words < 10 as b0, 100 * n_repeat_words > 20 * n_words as b1, 10 * n_symbols > word_chars as b2,
    n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines as b3, word_chars > 40 * n_words as b4,
    word_chars >= 40 and 10 * n_upper > 6 * word_chars as b5
  from measured)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, b0 or b1 as base_failed,
  not (b0 or b1 or b2 or b3 or b4 or b5) as kept,
  cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int as bigint) as failed
from bits"""
