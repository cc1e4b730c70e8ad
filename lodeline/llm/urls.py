"""URL verdicts: host and path rules, else logistic regression on character n-grams.

The model is trained on the driver from the small labelled URL table below (a
fixed size, whatever the input). Features are the distinct hashed character
n-grams (3 to 5) of the host and of the path, each with its own seed and with
boundary marks. Scoring is one pass without a shuffle.

Defined cases: a null url, or one without ://, has an empty host and path; no
rule fits an empty host, and the model allows it (no n-gram speaks against it).
Ties in the score (exactly 0.5) allow. Repeated rows come back each, a null page_id
stays null, urls of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BITS = 16
SIZES = (3, 4, 5)
STEPS, RATE, RIDGE = 400, 2.0, 1e-3

#: (verdict, host suffix, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The labelled URL table's parts: invented names and paths that are unwanted or wanted, by subject.
BAD_HOSTS = """spamhub spam-mail bulk-spam spammy-links farm-links linkfarm pills-shop online-pills buypills pillsdirect cheap-meds cheapdrugs cheap-deals
ads-server adserver click-ads ads-net adsdaily tracker-ads trackpixel track-clicks casino-royal bestcasino casino777 live-casino luckycasino win-prizes winbig
bigwin-now free-casino free-spins freebies-now free-money bets-now sportbets bets365 quickbets betsking adult-cams adultdate adult-videos xadult x-videos xxx-adult""".split()
GOOD_HOSTS = """river-notes garden-club history open-library weather daily-news science-blog recipes city-council museum school atlas theatre thanth rether
ingrown winterfarm farmers farmhouse old-farm trackside racetrack railtrack adults-education adulthood freedom freehold carefree pillow pillar caterpillar cinema
casing cascade betterment alphabets alphabet tibet window winery twine cheaper-by-dozen spamalot-theatre xavier exams adsorption downloads roads
monthly thesis theory mothers brothers earth northern southern lighthouse fourth thousand thirty thread threshold method anthology hearth wealth health
growth youth truth months others whether gather feather leather rather together hourly timely thistle ethics rhythm stations nations actions theatres honest
western eastern stones hundred wonder thunder thinner inner outer onion tension edition reason season person lesson heron heather teasing reading answer""".split()
BAD_PATHS = """/casino/bonus /free-bets/today /buy/cheap-pills /win/free-prizes /adult/cams /click/ads?id /bonus-bets/casino /pills/order-now /spam/links /free-pills/offer""".split()
GOOD_PATHS = """/en/12 /de/345.html /fr/67/ /es/890 /articles/gardens /history/of-rivers /news/2020/weather.html /library/books /about /articles/history""".split()
ENDINGS = ("example.org", "example.com", "example.net")
PREFIXES = ("", "www.", "blog.", "m.")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 = unwanted). Each name has hosts of its own under several prefixes and endings; unwanted
    ones have plain and unwanted paths, and some neutral hosts tell by the path alone."""
    out = []
    for label, hosts in ((1, BAD_HOSTS), (0, GOOD_HOSTS)):
        for i, host in enumerate(hosts):
            for j in range(4):
                bad = label and j == 3
                paths = BAD_PATHS if bad else GOOD_PATHS
                out.append((f"{PREFIXES[(i + j) % 4]}{host}.{ENDINGS[(i + j) % 3]}", paths[(i + j) % len(paths)], label))
    for i, (bad, good) in enumerate(zip(BAD_PATHS, GOOD_PATHS, strict=True)):
        for k in range(3):
            host = f"{PREFIXES[(i + k) % 4]}site{i * 3 + k}.{ENDINGS[k]}"
            out += [(host, bad, 1), (host, good, 0)]
    return out


def ngrams(host: str, path: str, bits: int = BITS) -> np.ndarray:
    found = set()
    for seed, text in ((0, f"^{host}$"), (1, f"^{path}$")):
        data = text.encode() if len(text) > 2 else b""
        for n in SIZES:
            found.update(zlib.crc32(data[i : i + n], seed) & (1 << bits) - 1 for i in range(len(data) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with a ridge; deterministic."""
    index = [ngrams(h, p) for h, p, _ in rows]
    y = np.array([label for _, _, label in rows], float)
    flat, owner = np.concatenate(index), np.repeat(np.arange(len(rows)), [len(i) for i in index])
    scale = 1 / np.sqrt(np.array([len(i) for i in index], float))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(owner, w[flat], len(rows)) * scale + bias)))
        g = (p - y) / len(rows)
        w -= RATE * 10 * (np.bincount(flat, (g * scale)[owner], 1 << BITS) + RIDGE * w / 10)
        bias -= RATE * g.sum()
    return w, bias


@lru_cache(maxsize=1)
def train() -> tuple[np.ndarray, float]:
    return fit(labelled_urls())


def score(host: str, path: str, model: tuple[np.ndarray, float] | None = None) -> float:
    """Chance that a URL is unwanted; 0 for an empty host and path."""
    index = ngrams(host, path)
    if not len(index):
        return 0.0
    w, bias = model or train()
    return float(1 / (1 + np.exp(-(w[index].sum() / np.sqrt(len(index)) + bias))))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])


def parts(url="url"):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url}, instr({url}, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host, path):
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(suffix + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, score, rule, verdict) for every row of pages."""
    host, path = parts()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(_score, "page_id long, host string, path string, score double")
    found = scored.withColumn("found", rule_of(F.col("host"), F.col("path")))
    model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "score", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", model).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
