"""Paged REST sources as a Python data source, or resumable over a folder of kept pages. Transport is a function, so fixtures work offline."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (url, body or None) -> (status, text)
Transport = Callable[..., tuple[int, str]]


class BudgetExceeded(RuntimeError):
    """The service says that the day's allowance is used up; trying again is pointless."""


def http(url: str, body: dict | None = None, headers: dict[str, str] | None = None) -> tuple[int, str]:
    data = None if body is None else json.dumps(body).encode()
    asked = urllib.request.Request(url, data, {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(asked, timeout=60) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def request(url: str, params: dict[str, str], body: dict | None = None, transport: Transport = http, retries: int = 6, pause: Callable[[float], None] = time.sleep):
    """One request, a POST where there is a body. 429 and 5xx are tried again after 1, 2, 4, ... seconds; a used-up budget
    and other codes fail at once."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for attempt in range(retries):
        code, answer = transport(full) if body is None else transport(full, body)
        if code == 200:
            return json.loads(answer)
        if code == 429 and "budget" in answer.lower():
            raise BudgetExceeded(answer[:200])
        if code != 429 and code < 500:
            raise RuntimeError(f"HTTP {code}: {answer[:200]}")
        if attempt + 1 < retries:
            pause(2.0**attempt)
    raise RuntimeError(f"HTTP {code} after {retries} attempts")


def get(url: str, params: dict[str, str], transport: Transport = http, retries: int = 6, pause: Callable[[float], None] = time.sleep, key: str | None = None, mailto: str | None = None) -> dict:
    """One GET; key and mailto say who asks."""
    who = {k: v for k, v in (("api_key", key), ("mailto", mailto)) if v}
    return request(url, params | who, None, transport, retries, pause)


def batches(ids: list[str], size: int) -> Iterator[list[str]]:
    """ids in their order without repetitions, so many at a time: what one call may ask for."""
    known = list(dict.fromkeys(ids))
    for at in range(0, len(known), size):
        yield known[at : at + size]


def by_ids(url: str, ids: list[str], size: int = 500, fields: str | None = None, transport: Transport = http, **options) -> Iterator[tuple[str, dict | None]]:
    """(id, record) of a batch endpoint that answers in the order asked, with null for what it does not know."""
    for some in batches(ids, size):
        answer = request(url, {"fields": fields} if fields else {}, {"ids": some}, transport, **options)
        if len(answer) != len(some):
            raise RuntimeError(f"{len(answer)} records for {len(some)} ids")
        yield from zip(some, answer, strict=True)


def sample(url: str, params: dict[str, str], n: int, seed: int, transport: Transport = http, **options) -> Iterator[dict]:
    """n records that the service draws with a seed, page by page, never more."""
    left, page = n, 1
    while left > 0:
        found = get(url, params | {"per-page": "200", "sample": str(n), "seed": str(seed), "page": str(page)}, transport, **options).get("results", [])
        if not found:
            return
        yield from found[:left]
        left, page = left - len(found), page + 1


def pages(url: str, params: dict[str, str], transport: Transport = http, **options) -> Iterator[dict]:
    """All results behind a cursor."""
    cursor = "*"
    while cursor:
        answer = get(url, params | {"per-page": "200", "cursor": cursor}, transport, **options)
        found = answer.get("results", [])
        yield from found
        cursor = answer.get("meta", {}).get("next_cursor") if found else None


def offset_pages(url: str, params: dict[str, str], transport: Transport = http, limit: int = 1000, **options) -> Iterator[dict]:
    """All results behind an offset; a failure raises, so a result is never cut short."""
    offset: int | None = 0
    while offset is not None:
        answer = get(url, params | {"offset": str(offset), "limit": str(limit)}, transport, **options)
        yield from answer.get("data", [])
        offset = answer.get("next")


def with_key(key: str, send: Callable[..., tuple[int, str]] = http, header: str = "x-api-key") -> Transport:
    """Sends the key in a header until the service refuses it (403); from then on it asks without one."""
    held = {"key": key}

    def transport(url: str, body: dict | None = None) -> tuple[int, str]:
        if held["key"]:
            code, text = send(url, body, {header: held["key"]})
            if code != 403:
                return code, text
            held["key"] = ""
        return send(url, body, {})

    return transport


def folder_transport(folder: str) -> Transport:
    """Answers from JSON files named by entity and cursor: `<entity>-<cursor>.json`."""
    def answer(url: str, body: dict | None = None) -> tuple[int, str]:
        parts = urllib.parse.urlsplit(url)
        query = dict(urllib.parse.parse_qsl(parts.query))
        name = parts.path.rstrip("/").rsplit("/", 1)[-1]
        try:
            with open(f"{folder}/{name}-{(query.get('cursor') or query.get('page') or query.get('offset') or '*').replace('*', 'first')}.json") as f:
                return 200, f.read()
        except FileNotFoundError:
            return 404, "no such fixture"

    return answer


class Entity(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if "fixtures" not in options and "url" not in options:
            raise ValueError("option url or fixtures is needed")

    def partitions(self) -> list[Entity]:
        return [Entity(x) for x in self.options["entities"].split(",") if x]

    def read(self, partition: Entity) -> Iterator[tuple]:
        o = self.options
        transport = folder_transport(o["fixtures"]) if "fixtures" in o else with_key(o["key"]) if "key" in o else http
        url = f"{o.get('url', 'file://fixtures')}/{partition.value}"
        params = {k: o[k] for k in ("filter", "select", "search", "group_by") if k in o}
        if "sample" in o:
            found = sample(url, params, int(o["sample"]), int(o.get("seed", "42")), transport, mailto=o.get("mailto"))
        elif o.get("paging", "cursor") == "offset":
            found = offset_pages(url, params, transport, mailto=o.get("mailto"))
        else:
            found = pages(url, params, transport, mailto=o.get("mailto"))
        for record in found:
            yield partition.value, json.dumps(record)


class PagedSource(DataSource):
    """format("paged_rest"): rows (entity, record as JSON). Options: entities (comma-separated); url or fixtures; paging
    (cursor or offset); filter, select, search, group_by; sample and seed; key, mailto.

    One partition per entity: a cursor is sequential, entities are not.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "entity string, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


PAGES = "entity string, nth int, next string, records array<string>, error string"


def page_after(url: str, params: dict[str, str], cursor: str, paging: str, transport: Transport, **options) -> tuple[list[str], str | None]:
    """The records of one page and where the next one begins; None after the last."""
    if paging == "offset":
        answer = get(url, params | {"offset": cursor, "limit": params.get("limit", "1000")}, transport, **options)
        following = answer.get("next")
        return [json.dumps(r) for r in answer.get("data", [])], None if following is None else str(following)
    answer = get(url, params | {"per-page": "200", "cursor": cursor}, transport, **options)
    found = answer.get("results", [])
    return [json.dumps(r) for r in found], answer.get("meta", {}).get("next_cursor") if found else None


def resumed(entities: DataFrame, folder: str, url: str, params: dict[str, str], paging: str = "cursor", transport: Callable[[], Transport] = lambda: http, per_round: int = 20, tasks: int = 8, **options) -> DataFrame:
    """(entity, record as JSON) of all pages of the entities (one column of names), which are kept in a folder.

    In a round each unfinished entity asks for up to per_round pages, from where its last kept page ended; what it has got
    is written before the next round, also if a later page failed, and only then is the failure raised. A rerun with the
    same url, params and paging asks for nothing that is there: finished entities are left out by a join with the kept
    pages, others go on. transport is made once a task, so it may hold a key.
    """
    spark = entities.sparkSession
    kept = f"{folder.rstrip('/')}/{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([url, sorted(params.items()), paging])).hex}"
    start = "0" if paging == "offset" else "*"
    names = entities.select(F.col(f"`{entities.columns[0]}`").cast("string").alias("entity")).filter("entity is not null").distinct()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = transport()
        for frame in frames:
            for entity, nth, cursor in frame.itertuples(index=False):
                for at in range(nth, nth + per_round):
                    try:
                        records, cursor = page_after(f"{url}/{entity}", params, cursor, paging, send, **options)
                    except Exception as e:  # told to the driver with the page that it hit
                        yield pd.DataFrame({"entity": [entity], "nth": [at], "next": [None], "records": [None], "error": [f"{type(e).__name__}: {e}"]})
                        break
                    yield pd.DataFrame({"entity": [entity], "nth": [at], "next": [cursor], "records": [records], "error": [None]})
                    if cursor is None:
                        break

    while True:
        path = spark._jvm.org.apache.hadoop.fs.Path(kept)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        done = spark.read.schema(PAGES).option("recursiveFileLookup", "true").parquet(kept) if there else spark.createDataFrame([], PAGES)
        state = done.filter("error is null").groupBy("entity").agg(F.max_by("next", "nth").alias("next"), F.max("nth").alias("last"))
        todo = names.join(state, "entity", "left").filter("last is null or next is not null")
        todo = todo.select("entity", (F.coalesce("last", F.lit(-1)) + 1).alias("nth"), F.coalesce("next", F.lit(start)).alias("cursor"))
        if todo.isEmpty():
            wanted = done.filter("error is null").join(names, "entity", "left_semi")
            return wanted.select("entity", F.explode("records").alias("record"))
        batch = f"{kept}/{uuid.uuid4().hex}"
        todo.repartition(tasks).mapInPandas(ask, PAGES).write.parquet(batch)
        failed = spark.read.schema(PAGES).parquet(batch).filter("error is not null").orderBy("entity").limit(3).collect()
        if failed:
            kind = BudgetExceeded if any(r.error.startswith("BudgetExceeded") for r in failed) else RuntimeError
            raise kind("; ".join(f"{r.entity}, page {r.nth}: {r.error}" for r in failed))
