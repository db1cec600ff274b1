"""URL filter: logistic regression on hashed character n-grams of host and path, under explicit rules.

Edge cases: a null url, or one without "://", has an empty host and path; such a url scores as the bare intercept,
which allows it. A table without rows gives no rows. Repeated rows are judged each by itself. Only the id and the url
are read, so further columns, whatever their names, don't matter. Urls of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 16
SIZES = (3, 4, 5)
THRESHOLD = 0.5
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

UNWANTED = (
    "adult sex xxx porn escort nude camgirl casino poker slots roulette jackpot betting bets gamble lottery win-big "
    "free-money spam spammy linkfarm farm clickbait pills viagra pharma payday loans quick-cash warez crack keygen torrent "
    "malware phishing hacked replica cheap-watches get-rich miracle-diet doorway"
).split()
WANTED = (
    "news wiki docs library school university museum archive journal science health garden recipes travel weather sports "
    "music history forum code manual standards city council energy research nature books letters radio theatre maps "
    "language family house water river mountain bakery market bridge"
).split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to st ion le ou ar".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 for unwanted. Both classes share subdomains, suffixes and paths, so only names tell them apart."""
    heads, tails = ("", "www.", "m.", "blog."), ("com", "net", "org")
    names = [(w, 1) for w in UNWANTED] + [(f"{a}-{b}", 1) for a, b in zip(UNWANTED, UNWANTED[7:] + UNWANTED[:7], strict=True)]
    names += [(f"{w}-{x}", 1) for w in UNWANTED for x in ("x", "win", "farm", "site", "online")]
    names += [(w, 0) for w in WANTED] + [(f"{a}-{b}", 0) for a, b in zip(WANTED, WANTED[5:] + WANTED[:5], strict=True)]
    names += [(f"{w}-{x}", 0) for w in WANTED for x in ("info", "online", "site")]
    names += [(a + b + c, 0) for k, (a, b, c) in enumerate(product(SYLLABLES, SYLLABLES, SYLLABLES)) if k % 37 == 0]
    paths = ("/en/12", "/de/7/", "/fr/345.html", "/es/88", "/index.html", "/a/b")
    return [
        (f"http{'s' * (k % 2)}://{heads[k % 4]}{name}.{'' if k % 3 else 'example.'}{tails[k % 3]}{paths[(k // 2) % 6]}", y)
        for k, (name, y) in enumerate(names)
    ]


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [p for c in "?#" if (p := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(LOWER), path


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams; host and path have their own."""
    found = set()
    for mark, text in ((b"h", f"^{host}$"), (b"p", f"^{path.lower()}$")):
        raw = text.encode()
        for n in SIZES:
            found.update(zlib.crc32(mark + raw[i : i + n]) & ((1 << BITS) - 1) for i in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(table: list[tuple[str, int]] | None = None, rounds: int = 250, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights, the intercept last, by Adagrad over the whole table."""
    table = labelled_urls() if table is None else table
    rows = [features(*parts(u)) for u, _ in table]
    y = np.array([v for _, v in table], float)
    row, at = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    for _ in range(rounds):
        z = np.bincount(row, w[at], len(rows)) * scale + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * weight
        grad = np.append(np.bincount(at, (g * scale)[row], 1 << BITS), g.sum()) + decay * w
        grad[:-1][np.bincount(at, minlength=1 << BITS) == 0] = 0
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w.astype(np.float32)


def score(w: np.ndarray, host: str, path: str) -> float:
    """Probability that the url is unwanted."""
    if not host:
        return float(1 / (1 + np.exp(abs(float(w[-1])))))
    at = features(host, path)
    return float(1 / (1 + np.exp(-(float(w[at].sum()) / max(1, len(at)) ** 0.5 + float(w[-1])))))


def matching(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | tuple[None, None]:
    """The longest rule that fits, as text, and its verdict."""
    best = None
    for verdict, domain, prefix in rules:
        if (host == domain or host.endswith("." + domain)) and path.startswith(prefix):
            best = max(best or (0, "", ""), (len(domain) + len(prefix), domain + prefix, verdict))
    return (best[1], best[2]) if best else (None, None)


def url_filter(pages: DataFrame, model: np.ndarray | None = None, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row. One narrow pass: nothing is shuffled, and the
    closure holds 2^16 weights whatever the input's size."""
    w = fit() if model is None else model

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                rule, verdict = matching(host, path, rules)
                p = score(w, host, path)
                out.append((host, path, rule, verdict or ("block" if p >= threshold else "allow"), p))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every url of pages, judged by the rules or else by the model."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
