"""Quality rules by weak supervision.

Each rule votes good, bad or abstains on a document, on evidence of its own. A document is good or bad in one of a few
ways: the way of one telling rule, or that of the hinting rules, of which several agree. Expectation-maximisation over the counts of vote patterns (at most 3 ** rules
rows, whatever the corpus) estimates the share of good documents and of each way of being bad, and how often each rule
says bad of documents of each sort, where it votes. A document's posterior probability of being good then decides: a
rule that says bad of good documents as well is overruled, and a telling one overrules all that speak for a document.
An abstaining rule moves nothing.

Defined results: null or blank text has no words and fails the base rules; a null doc_id and repeated rows are kept as
rows; an empty table gives an empty result and the prior model; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
ENDINGS = (".", "!", "?", '"', "'", ":", ";", ")", "…", "。")

RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "exclaiming", "endings")
BAD, GOOD, ABSTAIN = 0, 1, 2


@dataclass(frozen=True)
class Features:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_own_repeats: int  # the same where a repeated line counts once
    n_lines: int
    n_ended: int
    n_upper: int
    n_lower: int
    n_exclaims: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: Letters up to U+00FF; the rules on capitals need no more.
_UPPER = np.array([chr(c).isupper() for c in range(256)])
_LOWER = np.array([chr(c).islower() for c in range(256)])


def repeats(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    hit = np.array([seen[w] > 1 for w in windows])
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def features(text: str | None) -> Features:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    once = list(dict.fromkeys(lines))
    repeat = own = repeats(words)
    if repeat and len(once) < len(lines):
        own = repeats("\n".join(once).encode("utf-8", "surrogatepass").split())
    codes = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    return Features(
        n_words=len(words),
        word_chars=len(text) - sum(map(text.count, SPACES)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(once),
        n_repeat_words=repeat,
        n_own_repeats=own,
        n_lines=len(lines),
        n_ended=sum(x.rstrip(SPACES).endswith(ENDINGS) for x in lines),
        n_upper=int(_UPPER[codes].sum()),
        n_lower=int(_LOWER[codes].sum()),
        n_exclaims=text.count("!"),
    )


#: Fixed values of the rules: a measure up to the first votes good and from the second on bad, between them nothing.
LIMITS = {"symbols": (0.02, 0.1), "repeated_lines": (0.05, 0.15), "repeated_words": (0.05, 0.2), "capitals": (0.1, 0.3), "exclaiming": (0.02, 0.1)}
#: Words of a short and of a long text, mean lengths of usual and of odd words, and lines that tell something.
SHORT, LONG, USUAL, ODD, LINES = 50, 100, (3.5, 7.0), (2.5, 10.0), 4
#: Shares of lines with an ending that speak for and against prose.
ENDED, OPEN = 0.5, 0.1


def votes(x: Features) -> tuple[int, ...]:
    """One vote for each of RULES. A rule abstains where it has too little to go by, or where its measure is neither."""
    n = max(x.n_words, 1)
    mean = x.word_chars / n
    letters = x.n_upper + x.n_lower
    share = {
        "symbols": x.n_symbols / n,
        "repeated_lines": x.n_dup_lines / max(x.n_lines, 1),
        # Repeated lines are the other rule's evidence.
        "repeated_words": x.n_own_repeats / n,
        "capitals": x.n_upper / max(letters, 1),
        "exclaiming": x.n_exclaims / n,
    }
    found = {k: GOOD if share[k] <= low else BAD if share[k] >= high else ABSTAIN for k, (low, high) in LIMITS.items()}
    if x.n_lines < LINES:
        found["repeated_lines"] = ABSTAIN
    if letters < SHORT:
        found["capitals"] = ABSTAIN
    found["length"] = BAD if x.n_words < SHORT else GOOD if x.n_words >= LONG else ABSTAIN
    # Scripts without blanks make one word of a sentence.
    spaced = bool(x.n_lower) or mean <= ODD[1]
    found["word_length"] = GOOD if USUAL[0] <= mean <= USUAL[1] else BAD if spaced and not ODD[0] <= mean <= ODD[1] else ABSTAIN
    ended = x.n_ended / max(x.n_lines, 1)
    found["endings"] = ABSTAIN if x.n_lines < LINES else GOOD if ended >= ENDED else BAD if ended <= OPEN else ABSTAIN
    return tuple(found[k] for k in RULES)


def code(pattern: tuple[int, ...]) -> int:
    out = 0
    for v in pattern:
        out = out * 3 + v
    return out


#: How often a rule is taken to say bad of good documents before any votes.
FALSE_ALARM = {"symbols": 0.002, "capitals": 0.002, "exclaiming": 0.002, "word_length": 0.01, "length": 0.05, "repeated_lines": 0.05, "repeated_words": 0.05, "endings": 0.05}
#: The telling rules, each with a sort of bad documents of which it says bad so often at least.
TELLING, CAUGHT = ("symbols", "capitals", "exclaiming", "word_length"), 0.9
#: The hinting rules, with one sort of bad documents of which each of them says bad so often at least: one alone is
#: outvoted by the others' good votes, three of them outweigh a good vote of the fourth.
HINTING, HINTED = ("length", "repeated_lines", "repeated_words", "endings"), 0.5
#: So often at least they say bad of good documents, even where the corpus has no such case.
ERRING = 0.01
#: Least shares of bad votes by sort, good documents first, and rule.
LEAST = np.array([[ERRING if r in HINTING else 0.0 for r in RULES], *([CAUGHT if r == t else 0.0 for r in RULES] for t in TELLING), [HINTED if r in HINTING else 0.0 for r in RULES]])
#: Weight of these beliefs: so many votes, and so large a share of all documents, whatever the corpus's size.
BELIEF, BELIEF_SHARE = 10.0, 0.002


@dataclass(frozen=True)
class VoteModel:
    shares: tuple[float, ...]  # of good documents, then of each telling rule's bad ones, then of hinted ones
    says_bad: tuple[tuple[float, ...], ...]  # for each of these sorts, the share of each rule's votes that say bad

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """P(good) given the votes."""
        return float(_sorted_out(np.array([pattern]), np.array(self.shares), np.array(self.says_bad))[0, 0])

    def posteriors(self) -> dict[int, float]:
        """P(good) for every vote pattern, by its code."""
        every = np.array(list(product((BAD, GOOD, ABSTAIN), repeat=len(RULES))))
        p = _sorted_out(every, np.array(self.shares), np.array(self.says_bad))[:, 0]
        return dict(zip(map(code, every.tolist()), p.tolist(), strict=True))


def _sorted_out(patterns: np.ndarray, shares: np.ndarray, says_bad: np.ndarray) -> np.ndarray:
    """patterns x sorts: the probability of each sort given the votes."""
    odds = np.log(shares) + (patterns == BAD) @ np.log(says_bad).T + (patterns == GOOD) @ np.log1p(-says_bad).T
    p = np.exp(odds - odds.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def estimate(counts: dict[int, int], rounds: int = 500) -> VoteModel:
    """EM from pattern counts, with Beta priors on how often rules say bad."""
    rules, codes = len(RULES), sorted(counts)
    patterns = np.array([[c // 3**k % 3 for k in range(rules - 1, -1, -1)] for c in codes], np.int64).reshape(-1, rules)
    n = np.array([counts[c] for c in codes], np.float64)
    believed = np.maximum(LEAST, [FALSE_ALARM[r] for r in RULES])
    usual = np.array([0.8, *[0.2 / (len(LEAST) - 1)] * (len(LEAST) - 1)])
    shares, says_bad, belief = usual, believed, BELIEF + BELIEF_SHARE * n.sum()
    for _ in range(rounds):
        held = _sorted_out(patterns, shares, says_bad) * n[:, None]
        old = np.concatenate([shares, says_bad.ravel()])
        shares = (held.sum(axis=0) + BELIEF * usual) / (n.sum() + BELIEF)
        bad, voted = held.T @ (patterns == BAD), held.T @ (patterns != ABSTAIN)
        says_bad = np.clip((bad + belief * believed) / (voted + belief), 1e-6, 1 - 1e-6)
        says_bad = np.maximum(says_bad, LEAST)
        if np.abs(old - np.concatenate([shares, says_bad.ravel()])).max() < 1e-10:
            break
    return VoteModel(tuple(shares.tolist()), tuple(map(tuple, says_bad.tolist())))


def fit(docs: DataFrame) -> VoteModel:
    """The model from the vote patterns of all documents; each task adds up its own patterns before the shuffle."""
    bounded_batches(docs.sparkSession)

    def tally(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            seen.update(code(votes(features(x))) for x in batch.column(0).to_pylist())
        yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, "code int, n long")
    return estimate({r.code: r.n for r in rows.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()})


def judge(docs: DataFrame, model: VoteModel, least: float = 0.5) -> DataFrame:
    """Features, posterior and verdict of each row of docs."""
    bounded_batches(docs.sparkSession)
    table = model.posteriors()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(x) for x in batch.column(1).to_pylist()]
            p = [table[code(votes(x))] for x in found]
            failed = [x.base_failed for x in found]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([getattr(x, k) for x in found], pa.int64()) for k in longs), pa.array(failed, pa.bool_()), pa.array([not f and q >= least for f, q in zip(failed, p, strict=True)], pa.bool_()), pa.array(p, pa.float64())],
                ["doc_id", *longs, "base_failed", "kept", "posterior"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, " + ", ".join(f"{k} long" for k in longs) + ", base_failed boolean, kept boolean, posterior double")


def keep_good(docs: DataFrame, model: VoteModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps."""
    bounded_batches(docs.sparkSession)
    table, at = model.posteriors(), [c.lower() for c in docs.columns].index("text")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            found = [features(x) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([not x.base_failed and table[code(votes(x))] >= least for x in found], pa.bool_()))

    # Columns go by number, as names may hold dots.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
