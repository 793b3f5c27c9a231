"""Prepared data kept by fingerprint: versions that are written once and manifests that are committed last.

    root/key=<key>/<version>/data      rows, never written again
    root/key=<key>/_commits/<number>   one small JSON file a commit: the version, its settings and splits

A version counts from the moment its commit file is there whole. Writers that work at once each fill a version of their
own; the one that creates the next commit first wins, and the other drops its rows and reads the winner's. Readers name
a version's files, so a later commit doesn't change what they read; `prune` removes old versions when nobody does.

A crash leaves at most an uncommitted version, which no reader looks at. Commit files that can't be read (half written)
don't count. Creating a file that exists fails on the usual shared file systems; where that isn't atomic, the commit is
read back, and a writer that doesn't find its own version there has lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources import storage


def _commits(spark: SparkSession, place: str) -> list[tuple[int, dict]]:
    """The commits that can be read, by number."""
    out = []
    for name in storage.names(spark, f"{place}/_commits"):
        try:
            out.append((int(name), json.loads(storage.read_text(spark, f"{place}/_commits/{name}"))))
        except ValueError:
            continue
    return sorted(out, key=lambda x: x[0])


def _canonical(settings: Mapping | None, ignore: Sequence[str]) -> str:
    return json.dumps({k: v for k, v in (settings or {}).items() if k not in ignore}, sort_keys=True)


def current(spark: SparkSession, root: str, key: str, settings: Mapping | None = None, splits: Sequence[str] = (), ignore: Sequence[str] = ()) -> str | None:
    """The folder of the last committed version with these settings that has all these splits; None without one."""
    place, own = f"{root.rstrip('/')}/key={key}", _canonical(settings, ignore)
    for _, c in reversed(_commits(spark, place)):
        if c["settings"] == own and set(splits) <= set(c["splits"]):
            return f"{place}/{c['version']}"
    return None


def kept(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame], settings: Mapping | None = None, splits: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """The stored rows of this key and these settings; made and committed first if there are none.

    With splits, column `split` is a partition. Settings named in `ignore` don't affect the rows and aren't compared.
    """
    found = current(spark, root, key, settings, splits, ignore)
    if found is None:
        found = _committed(spark, root, key, make(), settings, splits, ignore)
    return spark.read.parquet(f"{found}/data")


def _committed(spark: SparkSession, root: str, key: str, df: DataFrame, settings: Mapping | None, splits: Sequence[str], ignore: Sequence[str]) -> str:
    place, version = f"{root.rstrip('/')}/key={key}", f"v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy("split") if splits else df.write
    writer.parquet(f"{place}/{version}/data")
    there = [n.partition("=")[2] for n in storage.names(spark, f"{place}/{version}/data") if n.startswith("split=")]
    text = json.dumps({"version": version, "settings": _canonical(settings, ignore), "splits": sorted(there)}, sort_keys=True)
    while True:
        if other := current(spark, root, key, settings, splits, ignore):  # committed by another meanwhile
            storage.delete(spark, f"{place}/{version}")
            return other
        number = max([0, *(int(n) for n in storage.names(spark, f"{place}/_commits") if n.isdigit())]) + 1
        name = f"{place}/_commits/{number:08d}"
        if storage.create(spark, name, text) and storage.read_text(spark, name) == text:
            return f"{place}/{version}"


def kept_by_source(spark: SparkSession, root: str, sources: Mapping[str, tuple[str, Callable[[], DataFrame]]], settings: Mapping | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """The rows of all sources together; only those whose fingerprint isn't stored yet are made. sources: id to (fingerprint, make)."""
    frames = [kept(spark, root, f"{name}-{key}", make, settings, ignore=ignore) for name, (key, make) in sources.items()]
    if not frames:
        raise ValueError("no sources")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prune(spark: SparkSession, root: str, key: str, keep: int = 1) -> list[str]:
    """Removes the versions of all but the last `keep` commits, and those never committed; returns their names.

    To be called when nothing reads or writes them.
    """
    place = f"{root.rstrip('/')}/key={key}"
    commits = _commits(spark, place)
    stay = {c["version"] for _, c in commits[len(commits) - keep :]} if keep > 0 else set()
    gone = [n for n in storage.names(spark, place) if n.startswith("v-") and n not in stay]
    for number, c in commits:
        if c["version"] not in stay:
            storage.delete(spark, f"{place}/_commits/{number:08d}")
    for n in gone:
        storage.delete(spark, f"{place}/{n}")
    return gone
