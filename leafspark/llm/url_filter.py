"""URL filters: rules by host and path, and for all other URLs gradient-boosted trees on lexical features.

The trees are fitted in numpy to a table of labelled URLs; statistics of suffixes come from the same table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowwise import struct_column

ALLOW, BLOCK = "allow", "block"

#: (rule: host and path, verdict)
RULES = (("com/en/", BLOCK), ("example.com/en/7", ALLOW), ("net/de/", ALLOW), ("example.net/de/8", BLOCK), ("org/es/", BLOCK))

#: Words of hosts that sell or cheat, and of hosts that don't. Fixed values, written by hand.
LURES = "casino casinos bets loans win pills cheap spam farm bet poker slots viagra loan payday free prize bonus xxx porn adult dating escort crypto profit money rich fast easy weight loss replica discount deals lottery jackpot hack crack keygen warez torrent seo backlinks".split()
PLAIN = "library museum garden weather history science kitchen travel school river music forest health city letters news market notes report culture stone village harbour theatre atlas journal".split()


def _labelled(rows: int = 2400, seed: int = 17) -> list[tuple[str, int]]:
    """The labelled URLs, by rule. Blocked ones: random or digit-stuffed hosts, tracking parameters, deep paths of
    numbers, chains of hyphens, two lures or three run together. Allowed ones: plain or made-up words, dated and
    numbered articles, one lure beside a plain word. Suffixes, subdomains and tails of both kinds overlap."""
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(len(of)))]
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ka mi lo pra sun".split()
    made = lambda least=2, most=5: "".join(pick(syllables) for _ in range(rng.integers(least, most)))
    noise = lambda n, of="bcdfghjklmnpqrstvwxyz0123456789": "".join(pick(of) for _ in range(n))
    number = lambda digits: str(rng.integers(10 ** (digits - 1), 10**digits))
    common, odd = ("com", "net", "org", "de", "co.uk", "fr", "example.com", "example.net", "example.org"), ("xyz", "top", "click", "info", "biz")
    fronts, tails = ("", "", "www.", "m.", "blog."), ("", "/", "#part", ".html", "?page=" + number(1), "?ref=x", "?q=" + made(), "?lang=en&v=2", "?sort=new&p=3", "?utm_source=mail&utm_medium=text")
    plain = lambda: f"/{pick(('en', 'de', 'fr', 'es', 'news', 'wiki'))}/{rng.integers(1, 9999)}"
    slug = lambda: f"/{rng.integers(1999, 2025)}/{rng.integers(1, 13):02d}/" + "-".join(made() for _ in range(rng.integers(2, 7)))
    query = lambda least: "?" + "&".join(f"{pick(('id', 'aff', 's', 'cid', 'utm', 'r', 'click', 'a', 'b'))}={noise(rng.integers(1, 9))}" for _ in range(rng.integers(least, 7)))
    out = []
    for k in range(rows // 2):
        suffix = pick(odd) if rng.random() < 0.5 else pick(common)
        path = pick((plain, slug, lambda: f"/{made()}/", lambda: ""))() + pick(tails)
        lure = lambda: pick(LURES)
        out.append(("http" + pick(("", "s")) + "://" + (
            f"{noise(rng.integers(8, 18))}.{suffix}{pick((path, '/' + query(2)))}" if k % 6 == 0
            else f"{made()}{number(rng.integers(2, 6))}-{made()}-{made()}.{suffix}/{query(3)}" if k % 6 == 1
            else f"{pick(fronts)}{made()}.{suffix}/" + "/".join(number(rng.integers(3, 9)) for _ in range(rng.integers(4, 9))) + query(2) if k % 6 == 2
            else f"{pick(fronts)}{'-'.join(pick((lure, made))() for _ in range(rng.integers(3, 6)))}.{suffix}{path}" if k % 6 == 3
            else f"{pick(fronts)}{lure()}{lure()}{lure()}.{suffix}{path}" if k % 12 == 4
            else f"{pick(fronts)}{lure()}-{noise(1)}.{suffix}{path}" if k % 24 == 10
            else f"{pick(fronts)}{lure()}-{lure()}.{suffix}{path}"
        ), 1))
        suffix = pick(odd) if rng.random() < 0.15 else pick(common)
        path = pick((plain, plain, slug, lambda: f"/docs/v{rng.integers(1, 9)}/{made()}", lambda: f"/{made()}/{made()}", lambda: ""))() + pick(tails)
        host = pick((made, made, lambda: pick(PLAIN), lambda: f"{pick(PLAIN)}-{pick(PLAIN)}", lambda: f"{made()}-{made()}", lambda: f"{lure()}-{pick((pick(PLAIN), made()))}"))()
        out.append((f"http{pick(('', 's'))}://{pick(fronts)}{host}.{suffix}{path}", 0))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    mark = (url or "").find("://")
    if mark < 0:
        return "", ""
    rest = url[mark + 3 :]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end]), path[:stop]


class Rules:
    """Looks up the longest rule that fits: host suffixes are tried in a table, so cost doesn't grow with the rules."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by: dict[str, dict[str, tuple[str, str]]] = defaultdict(dict)
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by[host][slash + path] = (rule, verdict)
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while host and at >= 0:
            suffix = host[at:]
            for n in self.lengths.get(suffix, ()):
                found = self.by[suffix].get(path[:n]) if n <= len(path) else None
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            at = host.find(".", at) + 1 or -1
        return best


FEATURES = ("length", "host length", "depth", "digit ratio", "host digit ratio", "entropy", "host entropy", "parameters", "parameter length", "hyphens of host", "labels", "longest label", "vowel ratio", "suspect words", "suffix rate", "suffix count")


def suffixes_of(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2) if len(labels) >= k]


def words_of(host: str) -> list[str]:
    """Words of the host's labels but for the last."""
    return re.findall(r"[a-z]{3,}", host.rpartition(".")[0])


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def lexical(url: str, suffix_rates: dict[str, tuple[float, int]]) -> list[float]:
    host, path = split_url(url)
    query = url.partition("?")[2].partition("#")[0] if "?" in url else ""
    labels = host.split(".")
    share = lambda s, of: sum(c in of for c in s) / max(1, len(s))
    known = [suffix_rates[s] for s in suffixes_of(host) if s in suffix_rates]
    return [
        len(url), len(host), sum(bool(p) for p in path.split("/")), share(url, "0123456789"), share(host, "0123456789"), _entropy(url), _entropy(host),
        len([p for p in query.split("&") if p]), len(query), host.count("-"), len(labels), max(map(len, labels)), share(host, "aeiou"),
        sum(suffix_rates.get(f"{w}-", (0.5, 0))[0] >= 0.55 for w in words_of(host)), max((r for r, _ in known), default=0.5), min((n for _, n in known), default=0),
    ]


def suffix_statistics(rows: list[tuple[str, int]]) -> dict[str, tuple[float, int]]:
    """Share of blocked URLs (smoothed) and number of URLs, by suffix, and by word of the host (with a hyphen behind)."""
    seen, bad = Counter(), Counter()
    for url, label in rows:
        host = split_url(url)[0]
        for s in (*suffixes_of(host), *(f"{w}-" for w in words_of(host))):
            seen[s] += 1
            bad[s] += label
    return {s: ((bad[s] + 5) / (n + 10), n) for s, n in seen.items() if n >= 5}


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> tuple:
    total, weight = gradient.sum(), hessian.sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            g, h = np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
            gain = g * g / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total * total / (weight + 1)
            gain[v[1:] == v[:-1]] = -1
            if len(gain) and gain.max() > best[0] + 1e-9:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return (float(total / (weight + 1)),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], gradient[low], hessian[low], depth - 1), _grow(x[~low], gradient[~low], hessian[~low], depth - 1)


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = _value(tree[2], x[low]), _value(tree[3], x[~low])
    return out


@dataclass
class Model:
    trees: list[tuple]
    rate: float
    suffix_rates: dict[str, tuple[float, int]]

    def block_probability(self, urls: list[str]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        x = np.array([lexical(u, self.suffix_rates) for u in urls], float)
        return 1 / (1 + np.exp(-self.rate * sum(_value(t, x) for t in self.trees)))


def fit(rows: list[tuple[str, int]], rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Model:
    """Boosting on the log loss, with second-order leaf values."""
    rates = suffix_statistics(rows)
    x, y = np.array([lexical(u, rates) for u, _ in rows], float), np.array([label for _, label in rows], float)
    trees, f = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(_grow(x, y - p, p * (1 - p), depth))
        f += rate * _value(trees[-1], x)
    return Model(trees, rate, rates)


@cache
def default_model() -> Model:
    return fit(_labelled())


def judged(url: Column, model, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> Column:
    """A struct column of host, path, rule, verdict and score; model is broadcast, rules are a short table."""

    def work(urls: list[bytes | None]) -> list:
        table = Rules(rules)
        texts = [None if u is None else u.decode() for u in urls]
        pairs = [split_url(t) for t in texts]
        found = [table.find(h, p) for h, p in pairs]
        score = model.value.block_probability([t or "" for t in texts])
        verdict = [f[1] if f else BLOCK if s >= threshold else ALLOW for f, s in zip(found, score)]
        return [[h for h, _ in pairs], [p for _, p in pairs], [f and f[0] for f in found], verdict, score]

    return struct_column(work, "host string, path string, rule string, verdict string, score double", url)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict and the model's score of every row. A null url, or one
    without `://`, has an empty host and path, fits no rule and is judged by its other features. Repeated rows come back as
    often as they came, an empty table gives none, other columns are ignored; a url of any length is read once."""
    model = pages.sparkSession.sparkContext.broadcast(default_model())
    return pages.select("page_id", judged(F.col("url"), model, rules).alias("_r")).select("page_id", "_r.*")
