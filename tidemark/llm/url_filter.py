"""URL filter: rules over host and path, and logistic regression on hashed character n-grams for the rest.

Host, path and rules are Spark SQL expressions, so they run inside whole-stage code; the model's probability is
an Arrow map over the two strings. The model is trained on the driver from a labelled table of fixed size and
is 2**BITS numbers, whatever the table of URLs holds. There is no shuffle.

A URL that is null or has no "://" has an empty host and path, fits no rule and is judged by the model (which
finds nothing to object to in empty strings). Of rules that fit, the longest wins; of equally long ones, the first.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14
SIZES = (3, 4, 5)
#: Labelled URLs as host/path; fixed values.
BLOCKED = """
casino-royale.example/slots/1
best-casino.example/bonus
play.casino-online.example/win
jackpot-win.example/play/22
lucky-win.example/spin
big-wins.example/lottery
free-bets-now.example/odds
sports-bets.example/live
online-betting.example/football
poker-stars.example/tables
cheap-pills-online.example/buy
discount-pills.example/order
pills-shop.example/viagra
cheap-meds.example/rx
cheap-watches.example/replica
adult-video.example/watch
adult-dating.example/join
adult-cams.example/live
xxx-tube.example/clip
porn-hub.example/video
sex-chat.example/room
spam-links.example/list
link-farm.example/page
spam-seo.example/backlinks
content-farm.example/spun
ads-server.example/click
track-ads.example/pixel
ad-tracker.example/redirect
click-track.example/go
pop-ads.example/banner
malware-drop.example/download
phish-login.example/verify
free-crack.example/keygen
warez-zone.example/torrent
payday-loan.example/apply
fast-cash.example/loan
earn-money-fast.example/join
hot-singles.example/meet
escort-girls.example/city
miracle-diet.example/weight-loss
"""
ALLOWED = """
www.library.example/catalogue/12
blog.travel-notes.example/2020/05/rome
news.morningpost.example/world/44
encyclopedia.example/wiki/Water
university.example/physics/lecture/3
docs.language.example/reference/strings.html
museum.example/collection/88
weather.example/forecast/oslo
recipes.example/soup/tomato
garden.example/plants/rose.html
history.example/articles/1066
m.gazette.example/en/120
www.chronicle.example/de/33
science.example/fr/journal/7
forum.bikes.example/es/thread/9
blog.kitchen.example/en/455.html
thesis.example/archive/2011
astronomy.example/stars/
health.example/advice/sleep
city-council.example/meetings/2
school.example/news/term
theatre.example/en/programme
orchestra.example/fr/concerts
northern-rail.example/times
booksellers.example/en/99
station.example/de/timetable
nation.example/en/71.html
theory.example/en/501
thinker.example/essays/8
tension.example/blog/5
therapy.example/articles/21
thousand.example/es/40
mathematics.example/fr/12/
library.nordic.example/en/3
m.reader.example/en/18
www.painter.example/works
chess-club.example/games
open-data.example/sets/4
poetry.example/en/sonnets
maps.example/region/
"""


class Rule(NamedTuple):
    action: str
    host: str
    path: str


#: Fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def buckets(texts: Sequence[str], marker: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram of texts, each between two marks."""
    data = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.array([len(d) + 2 for d in data], np.int64)
    codes = np.frombuffer(b"".join(b"\x02" + d + b"\x03" for d in data), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), lengths)
    rows, found = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, marker * 31 + n, np.uint64)
        for k in range(n):
            value = (value ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3)
            value ^= value >> np.uint64(29)
        inside = row[: len(value)] == row[n - 1 :]
        rows.append(row[: len(value)][inside])
        found.append((value[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight; a row's weights have a sum of squares of about 1."""
    parts = [buckets(hosts, 1), buckets(paths, 2)]
    row, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return row, bucket, 1 / np.sqrt(np.bincount(row, minlength=len(hosts)))[row]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        row, bucket, weight = features(hosts, paths)
        return 1 / (1 + np.exp(-(np.bincount(row, weight * self.weights[bucket], len(hosts)) + self.bias)))


def train(rows: Sequence[tuple[str, str, int]], steps: int = 1500, rate: float = 2.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent from zero: the same table always gives the same model."""
    row, bucket, weight = features([r[0] for r in rows], [r[1] for r in rows])
    label = np.array([r[2] for r in rows], float)
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(row, weight * weights[bucket], len(rows)) + bias))) - label
        weights -= rate * (np.bincount(bucket, weight * error[row], len(weights)) / len(rows) * 8 + decay * weights)
        bias -= rate * error.mean()
    return Model(weights, bias)


def labelled() -> list[tuple[str, str, int]]:
    return [(line.partition("/")[0], "/" + line.partition("/")[2], y) for text, y in ((BLOCKED, 1), (ALLOWED, 0)) for line in text.split()]


@functools.lru_cache(1)
def own_model() -> Model:
    return train(labelled())


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the action of the longest rule that fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, action = F.when(fits, rule.host + rule.path).otherwise(text), F.when(fits, rule.action).otherwise(action)
    return text, action


def judge(df: DataFrame, *keep: str, url: str = "url", rules: Sequence[Rule] = RULES, model: Model | None = None) -> DataFrame:
    """Columns keep, host, path, rule (null if none fits), verdict (allow or block) and probability (of block)."""
    model = model or own_model()

    @F.pandas_udf("double")
    def probability(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.probability(hosts.tolist(), paths.tolist()))

    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    split = df.select(*keep, host_of(address).alias("host"), path_of(address).alias("path"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.withColumn("probability", probability("host", "path"))
    verdict = F.coalesce(action, F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return scored.select(*keep, "host", "path", text.alias("rule"), verdict.alias("verdict"), "probability")
