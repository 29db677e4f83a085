"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware control of false discoveries.

Patterns give the base findings. The battery looks at every other run of 16 or more encoding characters that isn't a
plain word (runs that touch base findings: at what is left of them): it infers the encoding from the characters used,
and holds the run against two hypotheses.

* "even random characters of that encoding": a chi-squared test of the alphabet's uniformity, a runs test about the
  alphabet's middle and a serial-correlation test, each two-sided. Their p-values are joined by Fisher's rule.
* "ordinary text": how even would text's letters be (lower tail of the same chi-squared sum, from its exact mean and
  variance under letter shares of prose), and how often would text change between kinds of characters (upper tail of
  the binomial, signs left out). The two z-scores add up, divided by the deviation of their sum at a correlation of
  TEXT_SHARED.

A run's p-value is that of "ordinary text" divided by that of "random", 1 at most. As the latter is 1 at most, ordinary
text gets a small one no more often than its size says; a run that is neither text nor random gets a large one.
Long runs reject either hypothesis sooner than short ones, so discoveries are controlled by length: within each class
of lengths the p-values of the whole table go through the step-up rule at level `level` (on a grid of GRID steps a
class, so the counts that reach the driver are bounded whatever the table's size).

A null text counts as empty and has no findings. Rows are independent but for the thresholds, which are the same for
equal tables; ties and repeated rows get equal findings (each counts in the rule). An empty table gives an empty
result; columns but doc_id and text are never looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, map_batches, numbered, stage

#: Kinds in the order in which findings at one place are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run for the battery, and what makes it more than a word: a digit or sign, or a small letter before a capital one.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{16,}")
#: Where a run without an encoding is cut: at the signs of one base64 alphabet first, then at those of the other.
SEPARATORS = (re.compile("[^-_]+"), re.compile("[^+/]+"), re.compile("[^-_+/]+"))
#: A path or name of words: at least two parts, each a word of one case (or with a capital first) with a short number after it, or a short number.
OF_WORDS = re.compile(r"(?:(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,3}|\d{1,4})(?:[-_/+]+|$)){2,}")
NO_WORD = re.compile(r"[0-9+/_=]|[a-z][A-Z]")
#: Encodings from the narrowest: name, alphabet in the order of its values.
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UP + "234567"), ("lower36", _DIGITS + _LOW),
    ("upper36", _DIGITS + _UP), ("base62", _DIGITS + _UP + _LOW), ("base64", _UP + _LOW + _DIGITS + "+/"), ("base64url", _UP + _LOW + _DIGITS + "-_"),
)
_PLACE = {name: {c: k for k, c in enumerate(alphabet)} for name, alphabet in ENCODINGS}
_UPPER_HALF = {name: str.maketrans({c: "01"[2 * k >= len(alphabet)] for k, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS}
_SETS = [(name, frozenset(alphabet), len(alphabet)) for name, alphabet in ENCODINGS]
#: Sums of squared and cubed shares of characters in prose of one case (about 0.065 and 0.0055 for most European languages), and how often prose changes the kind of character inside a run.
TEXT_2, TEXT_3, TEXT_CHANGE = 0.065, 0.0055, 0.08
#: Correlation of the two scores under ordinary text: as measured over 21,000 identifiers and paths of program code.
TEXT_SHARED = 0.2
LENGTHS = (16, 20, 24, 32, 40, 64, 128)
GRID = 256
CANDIDATE = "struct<kind:string,start:int,stop:int,p:double>"
FOUND = f"doc_id long, n_assign long, n_access long, n_hex long, spans array<{CANDIDATE}>"


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(run: str) -> tuple[str, int] | None:
    used = set(run)
    return next(((name, size) for name, chars, size in _SETS if used <= chars), None)


def _moments(n: int, s2: float, s3: float) -> tuple[float, float]:
    """Mean and deviation of the sum of squared counts of n characters whose shares have these sums of squares and cubes."""
    var = 4 * n * (n - 1) * (n - 2) * max(0.0, s3 - s2 * s2) + 2 * n * (n - 1) * (s2 - s2 * s2)
    return n + n * (n - 1) * s2, math.sqrt(var)


def fisher(p_values: list[float]) -> float:
    """The chance that independent uniform values have a product as small as these (chi-squared of twice as many degrees)."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    return max(math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(p_values))), 1e-300)


def randomness(run: str, name: str, k: int) -> tuple[float, float, float]:
    """Two-sided p-values of the uniformity, runs and serial-correlation tests of `run` as random characters of an alphabet of k."""
    n = len(run)
    mean, sd = _moments(n, 1 / k, 1 / k**2)
    uniform = max(0.0, abs(sum(run.count(c) ** 2 for c in set(run)) - mean) - 1) / sd
    high = run.translate(_UPPER_HALF[name])
    a = high.count("1")
    mean = 1 + 2 * a * (n - a) / n
    sd = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    # Without a change of halves there is nothing to test by runs; that all lie in one half is told by its chance.
    runs = max(0.0, abs(1 + high.count("01") + high.count("10") - mean) - 1) / sd
    by_runs = 2 * _tail(runs) if 0 < a < n else 2.0 ** (1 - n)
    values = list(map(_PLACE[name].__getitem__, run))
    m = sum(values) / n
    spread = sum(map(mul, values, values)) - n * m * m
    cross = sum(map(mul, values, values[1:])) - m * (2 * n * m - values[0] - values[-1]) + (n - 1) * m * m
    serial = abs((cross / spread if spread > 1e-9 else 1.0) + 1 / n) * math.sqrt(n)
    return min(1.0, 2 * _tail(uniform)), min(1.0, by_runs), min(1.0, 2 * _tail(serial))


def ordinary(run: str) -> float:
    """The p-value of `run` as ordinary text, by evenness and changes of kind. Signs between the parts of a path or name are no change."""
    n = len(run)
    mean, sd = _moments(n, TEXT_2, TEXT_3)
    even = (mean - sum(run.count(c) ** 2 for c in set(run))) / sd
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in run if c.isalnum()]
    changes = sum(x != y and x + y != "ul" for x, y in zip(kinds, kinds[1:]))  # a small letter after a capital one is no change
    between = max(1, len(kinds) - 1)
    change = (changes - between * TEXT_CHANGE) / math.sqrt(between * TEXT_CHANGE * (1 - TEXT_CHANGE))
    return max(_tail((even + change) / math.sqrt(2 * (1 + TEXT_SHARED))), 1e-300)


def battery(run: str) -> float | None:
    """The p-value of `run` as ordinary text that its random look speaks for (1 where it looks no more random than like text); None if it has no encoding, or digits alone."""
    run = run.rstrip("=")
    told = encoding(run)
    if told is None or len(run) < 16 or told[0] == "decimal":  # even digits are ordinary: numbers, dates, card numbers
        return None
    return min(1.0, max(ordinary(run) / fisher(list(randomness(run, *told))), 1e-300))


def parts(run: str) -> list[tuple[int, int]]:
    """Where the strings to be tested lie in `run`: nowhere if it is a path or name of words, else all of it, or what lies between separators if it has no encoding."""
    if OF_WORDS.fullmatch(run):
        return []
    if encoding(run.rstrip("=")) is not None:
        return [(0, len(run))]
    for cut in SEPARATORS:
        found = [m.span() for m in cut.finditer(run) if m.end() - m.start() >= 16]
        if found and all(encoding(run[a:b].rstrip("=")) is not None for a, b in found):
            return found
    return []


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """Base findings with p = 0, and candidates of the battery with their p-values; places count code points."""
    out = [("assign", m.start(), m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), 0.0) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), 0.0) for m in HEX.finditer(text)]
    taken: list[list[int]] = []  # base findings, joined where they overlap
    for _, a, b, _ in sorted(out, key=lambda x: x[1]):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    for m in RUN.finditer(text):
        at, stop = m.span()
        k = bisect_left(ends, at + 1)
        while at < stop:  # what base findings leave of the run
            upto = min(stop, taken[k][0]) if k < len(taken) else stop
            for i, j in parts(text[at:upto]) if upto - at >= 16 else ():
                run = text[at + i : at + j]
                if NO_WORD.search(run) and (p := battery(run)) is not None:
                    out.append(("random", at + i, at + j, p))
            at = taken[k][1] if k < len(taken) else stop
            k += 1
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """FOUND for each row of `docs` (doc_id, text)."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [spans(s) if s else [] for s in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in row) for row in found], pa.int64()) for k in KINDS[:3]]
            rows = pa.array([[dict(zip(("kind", "start", "stop", "p"), x)) for x in row] for row in found], kind)
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, rows], ["doc_id", "n_assign", "n_access", "n_hex", "spans"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, FOUND)


def _class(length):
    return sum((length >= F.lit(x)).cast("int") for x in LENGTHS)


def _cell(p):
    """The grid cell of a p-value: -log2 p, in GRID steps of a quarter."""
    return F.least(F.lit(GRID - 1), F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * 4)).cast("int")


def thresholds(found: DataFrame, level: float) -> dict[int, int]:
    """For each class of lengths the least cell whose p-values are discoveries (step-up rule over the class's candidates)."""
    one = found.select(F.explode("spans").alias("s")).filter("s.kind = 'random'")
    cells = one.groupBy(_class(F.col("s.stop") - F.col("s.start")).alias("c"), _cell(F.col("s.p")).alias("cell")).count().collect()
    out = {}
    for c in {r["c"] for r in cells}:
        own = {r["cell"]: r["count"] for r in cells if r["c"] == c}
        total, so_far = sum(own.values()), 0
        for cell in sorted(own, reverse=True):
            so_far += own[cell]
            if 2.0 ** (-cell / 4) * total <= level * so_far:
                out[c] = cell
    return out


def scan(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """FOUND with base findings and discoveries only, ordered by start and kind. One pass over the texts; findings are staged."""
    found = stage(candidates(docs), "secrets")
    least = thresholds(found, level)

    def keep(s):
        told = F.lit(False)
        for c, cell in sorted(least.items()):
            told = told | (_class(s["stop"] - s["start"]) == c) & (_cell(s["p"]) >= cell)
        return (s["kind"] != "random") | told

    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(F.filter("spans", keep), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["p"].alias("p"))))
    return found.withColumn("spans", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["p"].alias("p"))))


def _joined(spans_):
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(docs: DataFrame, level: float = 0.01) -> DataFrame:
    found = scan(docs, level)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is_discovery(p: float, length: int, least: dict[int, int]) -> bool:
    cell = min(GRID - 1, math.floor(-math.log2(max(p, 1e-300)) * 4))
    return cell >= least.get(sum(length >= x for x in LENGTHS), GRID)


def redacted(text: str, least: dict[int, int]) -> str:
    """`text` with each base finding and discovery replaced by <kind>; of overlapping ones the first (then longest) names the place."""
    at, parts = 0, []
    for kind, start, stop, _ in sorted((s for s in spans(text) if s[0] != "random" or _is_discovery(s[3], s[2] - s[1], least)), key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """`docs` with findings in `text` replaced, n_chars counted anew; other columns stay, null texts stay null.

    The thresholds come from a first pass over all texts; the second changes each row where it is, whatever its id.
    """
    least = thresholds(stage(candidates(docs), "secrets"), level)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                texts = pa.array([redacted(s, least) if s else s for s in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if j == at else c for j, c in enumerate(part.columns)], names)

    new = numbered(docs).mapInArrow(run, docs.schema)
    return new.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
