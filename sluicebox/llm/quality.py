"""Quality rules as weak supervision.

Each rule looks at one measure of a whole text and votes good, votes bad or
abstains. Expectation-maximisation over the counts of vote patterns estimates how
often each rule gives each vote on good and on bad documents, and the share of
good ones; the posterior probability of good decides. No rule alone rejects.

The votes of all documents are counted; at most 3 ** (number of rules) patterns
reach the driver, whatever the number of documents. A document is rejected
outright (``base_failed``) below 20 words, or if more than 30 % of its words lie
in repeated windows of 8 words.

Null and empty texts have no words: all measures 0, ``base_failed`` true. Repeated
rows are judged alike, each in its own row. An empty table gives an empty result.
Other columns of the input are kept by ``with_verdict``, which refuses names of its
own counts and verdicts; ``only_kept`` takes columns of any name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import WORD, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
STEPS = 50
#: How often a rule's vote is believed right beforehand, and the weight of that against its own votes.
PRIOR_RIGHT, PRIOR_WEIGHT = 0.9, 1.0

GOOD, ABSTAIN, BAD = 1, 0, -1

_WORDS = re.compile(WORD)
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-ÞŒ]")
_ENDED = re.compile(r"[^\n]*[.!?…][\"'”’)\]]*[\x20\x09-\x0D]*$")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_ended", "n_capitals", "n_distinct", "n_shouted")


def repeated_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more in ``words``."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(WINDOW)), strict=True))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    twice = bytearray(n)
    for at, window in enumerate(windows):
        first = seen.setdefault(window, at)
        if first != at:
            twice[first] = twice[at] = 1
    covered, end = 0, 0
    at = twice.find(1)
    while at >= 0:
        covered += at + WINDOW - max(at, end)
        end = at + WINDOW
        at = twice.find(1, at + 1)
    return covered


def measures(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one whole text."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(1 for x in lines if _ENDED.match(x)),
        len(_CAPITALS.findall(text)),
        len(set(words)),
        text.count("!!"),
    )


def with_measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the counts of each text, a map over Arrow batches."""
    names = COUNTS + MORE
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += "".join(f", `{n}` bigint" for n in names)
    at_text = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = [measures(t) for t in some.column(at_text).to_pylist()]
                columns = [some.column(i) for i in range(some.num_columns)]
                columns += [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _vote(value: Column, good: Column | None = None, bad: Column | None = None) -> Column:
    vote = F.when(value.isNull(), ABSTAIN)
    if bad is not None:
        vote = vote.when(bad, BAD)
    if good is not None:
        vote = vote.when(good, GOOD)
    return vote.otherwise(ABSTAIN).cast("int")


def _per(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def rules() -> Mapping[str, Column]:
    """The rules by name: a vote for each row of measures.

    A rule speaks where its measure tells something: a text without symbols is
    no better for it, so that rule abstains there.
    """
    long = F.col("n_words") >= 40
    size, symbols = _per("word_chars", "n_words"), _per("n_symbols", "n_words")
    dup, repeated = _per("n_dup_lines", "n_lines"), _per("n_repeat_words", "n_words")
    ended, capitals = _per("n_ended", "n_lines"), _per("n_capitals", "word_chars")
    distinct, shouted = _per("n_distinct", "n_words"), _per("n_shouted", "n_words")
    votes = {
        "length": _vote(F.col("n_words"), good=F.col("n_words") >= 50),
        "ended_lines": _vote(ended, good=ended >= 0.8),
        "word_size": _vote(size, bad=(size < 2.5) | (size > 12)),
        "symbols": _vote(symbols, bad=symbols > 0.1),
        "same_lines": _vote(dup, bad=dup > 0.5),
        "repeats": _vote(repeated, bad=repeated > 0.25),
        "capitals": _vote(capitals, bad=capitals > 0.25),
        "distinct_words": _vote(distinct, bad=long & (distinct < 0.15)),
        "shouting": _vote(shouted, bad=shouted > 0.1),
    }
    # That no rule objects is evidence of its own, for which single abstentions do not stand.
    return votes | {"no_objection": F.when(F.least(*votes.values()) > BAD, GOOD).otherwise(ABSTAIN).cast("int")}


def fit(patterns: Mapping[tuple[int, ...], int], steps: int = STEPS) -> tuple[float, list, list]:
    """Share of good documents and, per rule, P(vote | good) and P(vote | bad), by EM.

    Kinds of bad text exclude one another, so a bad document draws the vote of a
    few rules only and agreement alone cannot show that a rule is right. Each
    rule's votes are therefore believed right ``PRIOR_RIGHT`` of the time
    beforehand, with the weight of ``PRIOR_WEIGHT`` times its own votes, which
    works alike at any number of documents. Abstaining says nothing about the
    class, and a rule is never taken to mean the opposite of its vote. The start
    calls a document bad if any rule does.
    """
    keys = sorted(patterns)
    n_rules = len(keys[0]) if keys else 0
    weight = {k: float(patterns[k]) for k in keys}
    total = sum(weight.values())
    good = {k: 1 - PRIOR_RIGHT if BAD in k else PRIOR_RIGHT for k in keys}
    share, given_good, given_bad = 0.5, [], []
    for _ in range(steps):
        mass = sum(weight[k] * good[k] for k in keys)
        share = (mass + 1) / (total + 2)
        given_good, given_bad = [], []
        for r in range(n_rules):
            a, b = {}, {}
            for vote in (BAD, GOOD):
                n = sum(weight[k] for k in keys if k[r] == vote)
                mine = sum(weight[k] * good[k] for k in keys if k[r] == vote)
                believed = n * (PRIOR_RIGHT if vote == GOOD else 1 - PRIOR_RIGHT)
                mine = (mine + PRIOR_WEIGHT * believed) / (1 + PRIOR_WEIGHT)
                a[vote] = (mine + 1) / (mass + 3)
                b[vote] = (n - mine + 1) / (total - mass + 3)
            a[BAD], b[GOOD] = min(a[BAD], b[BAD]), min(a[GOOD], b[GOOD])
            given_good.append(a)
            given_bad.append(b)
        good = {k: posterior(k, share, given_good, given_bad) for k in keys}
    return share, given_good, given_bad


def posterior(votes: tuple[int, ...], share: float, given_good: list, given_bad: list) -> float:
    a, b = share, 1 - share
    for r, vote in enumerate(votes):
        if vote != ABSTAIN:
            a *= given_good[r][vote]
            b *= given_bad[r][vote]
    return a / (a + b)


def with_verdict(
    docs: DataFrame, least_probability: float = 0.5, text_column: str = "text", drop_text: bool = False
) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``quality`` (posterior) and ``kept``."""
    measured = with_measures(docs, text_column)
    if drop_text:
        measured = measured.drop(text_column)
    measured = written(measured, "measures")
    votes = rules()
    names = list(votes)
    voted = measured.withColumn("_votes", F.array(*votes.values()))
    counted = voted.groupBy("_votes").count().collect()  # at most 3 ** rules rows
    patterns = {tuple(r["_votes"]): r["count"] for r in counted}
    share, given_good, given_bad = fit(patterns) if patterns else (0.5, [{}] * len(names), [{}] * len(names))
    spark = docs.sparkSession
    table = [(list(k), float(posterior(k, share, given_good, given_bad))) for k in sorted(patterns)]
    verdicts = spark.createDataFrame(table, "_votes array<int>, quality double")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        voted.join(F.broadcast(verdicts), "_votes", "left")
        .drop("_votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least_probability))
    )


def only_kept(docs: DataFrame, least_probability: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns, whatever their names."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    judged = with_verdict(docs.toDF(*places), least_probability, places[docs.columns.index("text")])
    return judged.filter("kept").select(*places).toDF(*docs.columns)
