"""Answers of remote services: fetched through a cache with an expiry, read as JSON, shaped into rows.

Nothing here opens a connection of its own: the caller gives the function that fetches, so tests and closed networks give recorded
answers. Which services there are, and what each answer's fields are called, is a table (``SHAPES``); a service without its
key in the environment is left out.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity, status_class

#: Seconds for which an answer is used again, by kind of service.
LIFETIMES = {"default": 300.0, "vcs": 900.0, "security": 3600.0}


class Cache:
    """Answers by address, each valid for its kind's seconds. ``clock`` gives the time."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, lifetimes: Mapping[str, float] = LIFETIMES) -> None:
        self._clock, self._lifetimes, self._kept = clock, lifetimes, {}

    def get(self, kind: str, address: str, fetch: Callable[[str], str]) -> object | None:
        """The parsed answer; None if fetching or parsing fails, which isn't kept."""
        now = self._clock()
        found = self._kept.get(address)
        if found and now - found[0] < self._lifetimes.get(kind, self._lifetimes["default"]):
            return found[1]
        try:
            answer = json.loads(fetch(address))
        except Exception:  # noqa: BLE001
            return None
        self._kept[address] = (now, answer)
        return answer


def available(services: Mapping[str, str | None], environment: Mapping[str, str] | None = None) -> list[str]:
    """The services whose key is set; those that need none are always there."""
    environment = os.environ if environment is None else environment
    return sorted(name for name, key in services.items() if key is None or environment.get(key))


def switched_off(path: str) -> bool:
    """Whether a switch file tells all tools to stop."""
    return os.path.exists(path)


#: Of each kind of answer: where its list of items is, the fields of an item, and the row made of them (column: expression over the item ``x``).
SHAPES: dict[str, tuple[str, str, dict[str, Callable[[Column], Column]]]] = {
    "vulnerabilities": ("vulns", "struct<id:string,summary:string,score:double,aliases:array<string>>", {
        "id": lambda x: x["id"], "summary": lambda x: F.substring(F.coalesce(x["summary"], F.lit("")), 1, 200), "score": lambda x: F.coalesce(x["score"], F.lit(0.0)), "severity": lambda x: severity(F.coalesce(x["score"], F.lit(0.0))),
    }),
    "issues": ("items", "struct<number:long,title:string,state:string,user:struct<login:string>,labels:array<struct<name:string>>,created_at:string>", {
        "number": lambda x: x["number"], "title": lambda x: x["title"], "state": lambda x: F.coalesce(x["state"], F.lit("unknown")), "author": lambda x: F.coalesce(x["user"]["login"], F.lit("")),
        "labels": lambda x: F.array_join(F.coalesce(x["labels"]["name"], F.array().cast("array<string>")), ","), "day": lambda x: F.substring(x["created_at"], 1, 10),
    }),
    "builds": ("builds", "struct<id:string,status:string,branch:string,finished_at:string>", {
        "id": lambda x: x["id"], "branch": lambda x: F.coalesce(x["branch"], F.lit("")), "status": lambda x: status_class(F.coalesce(x["status"], F.lit(""))), "day": lambda x: F.substring(F.coalesce(x["finished_at"], F.lit("")), 1, 10),
    }),
    "packages": ("packages", "struct<name:string,version:string,license:string,description:string,keywords:array<string>>", {
        "name": lambda x: x["name"], "version": lambda x: F.coalesce(x["version"], F.lit("")), "license": lambda x: F.coalesce(x["license"], F.lit("unknown")), "description": lambda x: F.substring(F.coalesce(x["description"], F.lit("")), 1, 200),
    }),
    "news": ("articles", "struct<title:string,url:string,publishedAt:string,source:struct<name:string>>", {
        "title": lambda x: x["title"], "url": lambda x: x["url"], "day": lambda x: F.substring(F.coalesce(x["publishedAt"], F.lit("")), 1, 10), "source": lambda x: F.coalesce(x["source"]["name"], F.lit("")),
    }),
    "language": ("results", "struct<label:string,text:string,score:double>", {
        "label": lambda x: x["label"], "text": lambda x: F.coalesce(x["text"], F.lit("")), "score": lambda x: F.round(F.coalesce(x["score"], F.lit(0.0)), 4),
    }),
}


def shaped(answers: DataFrame, kind: str) -> DataFrame:
    """(service, pos, ...): the items of raw answers (service, body) of one kind as rows, with defaults for missing fields. Bodies that are no JSON, and answers without items, give none."""
    items, item, row = SHAPES[kind]
    parsed = answers.select("service", F.from_json("body", f"struct<{items}: array<{item}>>")[items].alias("items"))
    flat = parsed.select("service", F.posexplode("items").alias("pos", "x"))
    return flat.select("service", F.col("pos").cast("long").alias("pos"), *[make(F.col("x")).alias(name) for name, make in row.items()])


def merged_news(items: DataFrame, limit: int = 20) -> DataFrame:
    """(title, url, day, source, n_services): the latest articles of several services, each address once (of the first service by name)."""
    first = F.min(F.struct("service", "pos", "title", "day", "source"))
    one = items.filter(F.col("url").isNotNull()).groupBy("url").agg(first.alias("m"), F.count_distinct("service").alias("n_services"))
    return one.select("m.title", "url", "m.day", "m.source", "n_services").orderBy(F.desc("day"), "url").limit(limit)


def security_report(vulnerabilities: DataFrame) -> DataFrame:
    """(severity, n, worst): findings per severity band, over all services; a finding that several services report counts once."""
    one = vulnerabilities.groupBy("id").agg(F.max("score").alias("score"))
    return one.groupBy(severity(F.col("score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("score", "id")).alias("worst"))


def build_report(builds: DataFrame) -> DataFrame:
    """(service, n, passed, failed, success): builds per service and the share of finished ones that passed."""
    passed, failed = (F.sum((F.col("status") == s).cast("long")) for s in ("passed", "failed"))
    counted = builds.groupBy("service").agg(F.count(F.lit(1)).alias("n"), passed.alias("passed"), failed.alias("failed"))
    return counted.withColumn("success", F.round(F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0)), 4))


def dashboard(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(name, body): each small table as one JSON document, a list of its rows in their order by all columns; tables here are reports, never data."""
    from functools import reduce

    docs = [
        df.agg(F.to_json(F.coalesce(F.array_sort(F.collect_list(F.struct("*"))), F.array())).alias("body")).select(F.lit(name).alias("name"), "body") for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, docs)
