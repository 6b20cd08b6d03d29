"""Quality rules as a short-circuit cascade: the rules that reject most per unit of cost go first."""

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_batches, documents, forget_worker_state, sampled
from tallyframe.llm.registry import query
from tallyframe.session import quoted

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# The order of the rules is estimated on so many documents.
SAMPLE_DOCS = 512


class Text:
    """Measures of one whole text, each taken when first asked for. Words end at ASCII white space."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def lines(self) -> list[str]:
        """Lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def duplicate_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated_words(self) -> int:
        """Words that stand in a window of WINDOW words found at least twice."""
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        if len(ids) <= WINDOW:
            return 0
        code, size, one = ids, len(number), len(number)
        for shift in range(1, WINDOW):
            if size * one >= 1 << 63:
                values, code = np.unique(code, return_inverse=True)
                size = len(values)
            code = code[:-1] * one + ids[shift:]
            size *= one
        _, which, counts = np.unique(code, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(counts[which] > 1)
        edges = np.bincount(twice, minlength=len(ids) + 1) - np.bincount(twice + WINDOW, minlength=len(ids) + 1)
        return int((np.cumsum(edges) > 0).sum())

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(map(str.isupper, self.text))


# Each rule says whether it rejects a text. The first two alone make `base_failed`.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: len(t.words) < 10,
    "repeated_words": lambda t: 100 * t.repeated_words > 20 * len(t.words),
    "symbols": lambda t: 10 * t.symbols > len(t.words),
    "word_length": lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words),
    "duplicate_lines": lambda t: 2 * t.duplicate_lines > len(t.lines),
    "few_letters": lambda t: 2 * t.letters < t.word_chars,
    "capitals": lambda t: 2 * t.capitals > t.letters,
}


def weigh_rules(texts: list[str | None], rules: dict[str, Callable[[Text], bool]]) -> dict[str, tuple[int, float]]:
    """Rejections and seconds of every rule on `texts`, each text measured anew for each rule."""
    worth = {}
    for name, rejects in rules.items():
        start = time.perf_counter()
        rejected = sum(bool(rejects(Text(t))) for t in texts)
        worth[name] = rejected, max(time.perf_counter() - start, 1e-9)
    return worth


def order_rules(texts: list[str | None], rules: dict[str, Callable[[Text], bool]]) -> list[str]:
    """Names of the rules by rejections per second on `texts`."""
    worth = weigh_rules(texts, rules)
    return sorted(rules, key=lambda name: -worth[name][0] / worth[name][1])


def cascade_order(df: DataFrame, text: str, rules=None, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The order of the rules, estimated on about `sample_docs` rows by the executors that hold them; only sums reach the driver.
    The order changes the cost and never the verdict."""
    rules = rules or RULES
    schema = pa.schema([("rule", pa.string()), ("rejected", pa.int64()), ("seconds", pa.float64())])

    def run(batches):
        for b in batches:
            worth = weigh_rules(b.column(0).to_pylist(), rules)
            yield pa.RecordBatch.from_pylist([{"rule": n, "rejected": r, "seconds": s} for n, (r, s) in worth.items()], schema=schema)

    texts = sampled(bounded_batches(df).select(quoted(text).alias("text")), "text", sample_docs).distinct()
    found = texts.mapInArrow(run, "rule string, rejected long, seconds double").groupBy("rule").agg(
        F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    worth = {r["rule"]: r["rejected"] / r["seconds"] for r in found.collect()}
    return sorted(rules, key=lambda name: -worth.get(name, 0.0))


def first_rejection(text: Text, order: list[str], rules=None) -> str | None:
    """Name of the first rule that rejects, None for a text that all rules keep; later rules aren't run."""
    rules = rules or RULES
    return next((name for name in order if rules[name](text)), None)


def keep_good(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text all rules keep, with all their columns, whatever their names and types. Null and empty texts fail
    `few_words`."""
    order = cascade_order(df, text)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_worker_state()
        for texts in batches:
            yield pa.array([first_rejection(Text(t.as_py()), order) is None for t in texts], pa.bool_())

    return bounded_batches(df).where(good(quoted(text)))


def measured(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of `df`.

    The five measures are columns, so all rows pay for them; the cascade then only decides about what costs more than they do
    (letters, capitals), for texts that no earlier rule rejects.
    """
    order = cascade_order(df, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = []
            for value in b.column(len(keys)):
                t = Text(value.as_py())
                kept = first_rejection(t, order) is None
                rows.append((len(t.words), t.word_chars, t.symbols, t.duplicate_lines, t.repeated_words,
                             any(RULES[r](t) for r in ("few_words", "repeated_words")), kept))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keys)], *[pa.array(c, pa.int64()) for c in columns[:5]],
                 *[pa.array(c, pa.bool_()) for c in columns[5:]]], names=[*held, *names, "base_failed", "kept"])

    held = [f"key{i}" for i in range(len(keys))]
    own = bounded_batches(df).select(*[quoted(k).alias(n) for k, n in zip(keys, held)], quoted(text).alias("text"))
    schema = ", ".join([*[f"{c} {t}" for c, t in own.dtypes[:-1]], *[f"{c} long" for c in names],
                        "base_failed boolean, kept boolean"])
    return own.mapInArrow(run, schema).select(*[F.col(n).alias(k) for k, n in zip(keys, held)], *names, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e,
               lead(word, 4) OVER o AS f FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, f IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c, e, f) > 1 AS t FROM win),
hit AS (SELECT doc_id, i, bool_or(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h
        FROM twice),
rep AS (SELECT doc_id, count(*) FILTER (h) AS n_repeat_words FROM hit GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             length(regexp_replace(text, '\P{L}', '', 'g')) AS letters,
             length(regexp_replace(text, '\P{Lu}', '', 'g')) AS capitals FROM w),
a AS (SELECT m.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND 2 * n_dup_lines <= n_lines AND 2 * letters >= word_chars AND 2 * capitals <= letters AS kept FROM v"""


@query(ORACLE)
def op6_quality_rules(spark, folder):
    return measured(documents(spark, folder), ["doc_id"], "text")
