"""Secret scans: three base patterns, and a battery of randomness tests on long tokens. Built-in functions only.

A token is a longest run of [A-Za-z0-9+/_-] with the '=' that end it, 20 or more characters in all; what follows a '='
is a token of its own, as in NAME=value. Its encoding is inferred (hex, base32, base36, base62 or base64; it must hold
letters and digits). Tests measure how far it is from uniform random characters:
Pearson's chi-squared of its alphabet's letters and of its classes of letters (capitals, small letters, digits, marks),
runs of one class, and lag-1 serial correlation, each standardised with its exact moments at the token's length. Their
sum of squares gives one p-value.

Random tokens have uniform p-values, text has p-values near 0. In each stratum (encoding, binary magnitude of length)
the share of random tokens among the distinct ones is estimated from the upper half, and tokens above the least
threshold are reported at which the estimated share of others among them is at most `rate`: the threshold is stricter
where short text looks random.

Defined results: null text is empty; texts without findings have empty spans; a null doc_id and repeated rows are kept
as rows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, quoted

#: Fixed values of the contract. Runs of fewer characters than a kind asks for never begin a longer match, so the lower
#: bounds of access and hex stand in the pattern; those of assign must not, as a short match still takes up its text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
_BODY = "[A-Za-z0-9+/_-]"
#: '=' belongs to a token only where none of its characters follows. A shorter run counts with its '=' to 20.
_PADDED = "|".join(f"{_BODY}{{{20 - n}}}={{{n}}}" for n in range(1, 20)) + "|={20}"
TOKEN = rf"(?<!{_BODY}){_BODY}++(?:(?<={_BODY}{{20}})(?:=++(?!{_BODY}))?+|=++(?!{_BODY})(?<={_PADDED}))"

#: Alphabets by encoding, in the order in which they are tried.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base62", r"^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Bins of p-values.
BINS = 200
#: Values that a running result takes at a time, and code points of a block from which parts of a text are cut.
BLOCK, STRETCH = 256, 1024


def class_starts(alphabet: str) -> list[int]:
    """Where capitals, small letters, digits and marks begin in an alphabet."""
    kinds = [next(i for i, test in enumerate((str.isupper, str.islower, str.isdigit, lambda _: True)) if test(c)) for c in alphabet]
    return [i for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op) -> Column:
    """Inclusive running results of an associative op over an array of longs, in blocks, so that time stays linear."""

    def plain(block: Column) -> Column:
        start = F.struct(block[0].alias("at"), F.slice(block, 1, 1).alias("out"))

        def step(s: Column, x: Column) -> Column:
            return _let(op(s["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(s["out"], y).alias("out")))

        return F.aggregate(F.slice(block, 2, F.size(block)), start, step, lambda s: s["out"])

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: plain(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

        def shifted(inside: Column) -> Column:
            before = plain(F.transform(inside, lambda x: F.element_at(x, -1)))
            return _let(before, lambda t: F.flatten(F.transform(inside, lambda x, i: F.when(i == 0, x).otherwise(_let(t[i - 1], lambda o: F.transform(x, lambda y: op(o, y)))))))

        return _let(blocks, shifted)

    empty = F.array().cast("array<bigint>")
    return _let(values, lambda v: F.when(F.size(v) > BLOCK, blocked(v)).when(F.size(v) > 0, plain(v)).otherwise(empty))


def matches(text: Column, pattern: str, needed: Column | None = None) -> Column:
    """array<struct<start, end, value, needed>> of all matches, in code points, end exclusive.

    The text is split at the matches; running lengths of pieces and matches give the ends. needed: another array by match.
    """

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running(F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.length(m)).cast("long")), lambda a, b: a + b)
        spans = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        return F.zip_with(spans, needed if needed is not None else found, lambda x, n: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), n.alias("needed")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed))


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(found: Column, kind: str) -> Column:
    return F.coalesce(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))), F.array().cast(_SPANS))


def base_spans(text: Column) -> list[Column]:
    """array<struct<start, kind, end>> for each base kind."""
    assign = matches(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    return [_spans(F.filter(assign, lambda m: F.length(m["needed"]) >= 6), "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")]


def _survival(s: Column) -> Column:
    """P(sum of squares > s) for uniform letters: two of its four parts are 0 half of the time, so chi-squared with 2, 3
    and 4 degrees of freedom mix. The error function of the middle one is a rational approximation (error < 2e-7).
    """
    series = lambda t: t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592)

    def mixed(s: Column) -> Column:
        three = _let(F.lit(1.0) / (F.sqrt(s / 2) * 0.3275911 + 1), series) + F.sqrt(s * 2 / 3.141592653589793)
        return F.exp(-s / 2) * (F.lit(0.25) + three / 2 + (s / 2 + 1) / 4)

    return _let(s, mixed)


def battery(token: Column) -> Column:
    """struct<encoding, magnitude, p> of a token; encoding is null where none is inferred."""

    def inferred(body: Column) -> Column:
        at = F.lit(None).cast("int")
        for k in range(len(ALPHABETS) - 1, -1, -1):
            at = F.when(token.rlike(ALPHABETS[k][1]), k).otherwise(at)
        return F.when(body.rlike("[0-9]") & body.rlike("[A-Za-z]"), _let(at, lambda k: F.when(k.isNotNull(), _tests(body, k))))

    return _let(F.rtrim(token, F.lit("=")), inferred)


def _tests(body: Column, at: Column) -> Column:
    names, letters = (F.array(*(F.lit(x[k]) for x in ALPHABETS)) for k in (0, 2))
    firsts = F.array(*(F.array(*map(F.lit, class_starts(x[2]))) for x in ALPHABETS))
    start = F.struct(body.alias("t"), F.element_at(names, at + 1).alias("e"), F.element_at(letters, at + 1).alias("a"), F.element_at(firsts, at + 1).alias("f"), F.length(body).cast("double").alias("n"))
    characters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def measure(x: Column) -> Column:
        places = F.transform(characters(x["t"]), lambda c: _let(F.instr(x["a"], c) - 1, lambda v: F.struct(v.cast("double").alias("v"), F.size(F.filter(x["f"], lambda f: f <= v)).alias("c"))))
        return _let(F.struct(*(x[c].alias(c) for c in "teafn"), F.length(x["a"]).cast("double").alias("k"), places.alias("v")), statistic)

    def uniformity(n: Column, cells: Column) -> Column:
        """Pearson's chi-squared of cells (held, share of the alphabet), standardised; what is below its mean counts 0."""
        start = F.struct(F.lit(0.0).alias("chi"), F.lit(0.0).alias("inverse"), F.lit(0.0).alias("m"))

        def add(s: Column, c: Column) -> Column:
            off = c["held"] - n * c["share"]
            return F.struct((s["chi"] + off * off / (n * c["share"])).alias("chi"), (s["inverse"] + F.lit(1.0) / c["share"]).alias("inverse"), (s["m"] + 1).alias("m"))

        return F.aggregate(cells, start, add, lambda s: F.greatest((s["chi"] - (s["m"] - 1)) / F.sqrt((s["m"] - 1) * 2 + (s["inverse"] - s["m"] * s["m"] - s["m"] * 2 + 2) / n), F.lit(0.0)))

    def statistic(x: Column) -> Column:
        n, k, middle = x["n"], x["k"], (x["k"] - 1) / 2
        cell = lambda held, share: F.struct(held.cast("double").alias("held"), share.alias("share"))
        by_letter = F.transform(characters(x["a"]), lambda c: cell(F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(1.0) / k))
        ends = F.concat(F.slice(x["f"], 2, F.size(x["f"]) - 1), F.array(k.cast("int")))
        by_class = F.zip_with(x["f"], ends, lambda a, b: cell(F.size(F.filter(x["v"], lambda v: (v["v"] >= a) & (v["v"] < b))), (b - a) / k))
        pairs = F.zip_with(F.slice(x["v"], 1, (n - 1).cast("int")), F.slice(x["v"], 2, (n - 1).cast("int")), lambda a, b: F.struct(((a["v"] - middle) * (b["v"] - middle)).alias("product"), F.when(a["c"] == b["c"], 1.0).otherwise(0.0).alias("same")))
        start = F.struct(F.lit(0.0).alias("product"), F.lit(0.0).alias("same"))
        steps = F.aggregate(pairs, start, lambda s, p: F.struct((s["product"] + p["product"]).alias("product"), (s["same"] + p["same"]).alias("same")))
        due = F.aggregate(by_class, F.lit(0.0), lambda s, c: s + c["share"] * c["share"])

        def squared(z: Column) -> Column:
            runs = _let(z["due"], lambda q: (z["steps"]["same"] - (n - 1) * q) / F.sqrt((n - 1) * q * (F.lit(1.0) - q)))
            serial = z["steps"]["product"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
            parts = F.array(uniformity(n, by_letter), uniformity(n, by_class), runs, serial)
            return F.aggregate(parts, F.lit(0.0), lambda s, y: s + y * y)

        p = _survival(_let(F.struct(steps.alias("steps"), due.alias("due")), squared))
        return F.struct(x["e"].alias("encoding"), F.floor(F.log2(n)).cast("int").alias("magnitude"), p.alias("p"))

    return _let(start, measure)


def tokens(text: Column) -> Column:
    """array<struct<start, end, value, test>> of the tokens with an inferred encoding."""
    found = F.transform(matches(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), battery(m["value"]).alias("test")))
    return F.filter(found, lambda m: m["test"].isNotNull())


def thresholds(docs: DataFrame, rate: float = 0.05) -> dict[tuple[str, int], float]:
    """For each stratum the least p-value (in steps of 1 / BINS) that keeps false discoveries at `rate`.

    Counts of the distinct tokens of all documents, by stratum and bin: a token that is copied into many documents is
    one piece of evidence. Strata are few: encodings times binary magnitudes.
    """
    text = F.col("text").cast("string")
    each = docs.where(text.rlike(TOKEN)).select(F.explode(tokens(text)).alias("t")).select("t.test.*", F.xxhash64("t.value").alias("token"))
    distinct = each.select("encoding", "magnitude", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "token").distinct()
    rows = distinct.groupBy("encoding", "magnitude", "bin").count().collect()
    counts: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        counts.setdefault((r.encoding, r.magnitude), [0] * BINS)[r.bin] += r["count"]
    return {k: _threshold(c, rate) for k, c in counts.items()}


def _threshold(counts: list[int], rate: float) -> float:
    random = 2 * (sum(counts[BINS // 2 :]) + 0.5)
    for least in range(1, BINS // 2):
        above = sum(counts[least:])
        if not above or 1 - random * (1 - least / BINS) / above <= rate:
            return least / BINS
    return 0.5


def scan(text: Column, least: dict[tuple[str, int], float]) -> Column:
    """array<struct<start, kind, end>> in order: base spans, and the random ones that touch none of these.

    Whether a base span touches a random one is read off two running values over the ordered spans: the largest end of
    the base spans before it, and the least start of those behind it.
    """
    base = base_spans(text)
    if not least:
        return F.array_sort(F.concat(*base))
    table = F.create_map(*(x for (e, m), t in sorted(least.items()) for x in (F.lit(f"{e}/{m}"), F.lit(t))))
    found = F.filter(tokens(text), lambda m: m["test"]["p"] >= F.coalesce(F.element_at(table, F.concat_ws("/", m["test"]["encoding"], m["test"]["magnitude"].cast("string"))), F.lit(1.0)))
    random, far = KINDS.index("random"), F.lit(1 << 60).cast("long")

    def apart(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(s["kind"] < random, s["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < random, s["start"]).otherwise(far))), F.least))
        around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(spans, around, lambda x, a: F.when((x["kind"] < random) | (a["e"] <= x["start"]) & (x["end"] <= a["s"]), x))
        return F.filter(marked, lambda x: x.isNotNull())

    def merged(spans: Column) -> Column:
        return F.when(F.exists(spans, lambda s: s["kind"] == random), apart(spans)).otherwise(spans)

    return _let(F.array_sort(F.concat(*base, _spans(found, "random"))), merged)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, found, base, all): counts by kind as a struct, and both joined lists kind:start:end."""
    least = thresholds(docs, rate)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scan(F.coalesce(F.col("text").cast("string"), F.lit("")), least).alias("s"))
    of_kind = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long")
    counts = F.struct(*(of_kind(k).alias(kind) for k, kind in enumerate(KINDS)))
    base = F.filter("s", lambda s: s["kind"] < KINDS.index("random"))
    return x.select("doc_id", counts.alias("found"), _joined(base).alias("base"), _joined(F.col("s")).alias("all"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each stretch that the ordered spans cover replaced by `mark`; touching spans are one stretch each.

    Parts are cut from blocks of the text, as cutting at a place of a long string reads all before it.
    """
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends"))

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / STRETCH).cast("int")
        own = F.array_join(F.slice(blocks, first + 1, F.floor(end / STRETCH).cast("int") - first + 1), "")
        return F.when(start < end, F.substr(own, (start - first * STRETCH + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def put(x: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            after = F.when(i > 0, x["ends"][i - 1]).otherwise(F.lit(0).cast("long"))
            return _let(after, lambda a: F.when(s["start"] >= a, F.concat(cut(x["blocks"], a, s["start"]), F.lit(mark))).otherwise(""))

        tail = cut(x["blocks"], F.element_at(x["ends"], -1), F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(x["spans"], before), ""), tail)

    return _let(whole, put)


def redact(docs: DataFrame, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of its texts that spans cover replaced by `mark`; all rows and columns stay."""
    least = thresholds(docs, rate)
    tmp, columns = fresh_name(docs, "spans"), docs.columns
    name = next(c for c in columns if c.lower() == "text")
    text = quoted(name)
    marked = docs.select(*map(quoted, columns), scan(F.coalesce(text.cast("string"), F.lit("")), least).alias(tmp))
    return marked.select(*(F.when(F.size(tmp) > 0, masked(text, F.col(tmp), mark)).otherwise(text).alias(c) if c == name else quoted(c) for c in columns))
