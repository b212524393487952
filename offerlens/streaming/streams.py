"""Streams of observations: change-only history, snapshots, the review queue, alerts and their triggers, store health; with the batch operators' meaning."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from offerlens.operators.alerts import firing
from offerlens.operators.health import UNHEALTHY
from offerlens.operators.offers import KEY

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HISTORY = "series_id long, recorded_at timestamp, seq long, price decimal(10,2), availability string"


class _Changes(StatefulProcessor):
    """Keeps a series' last price and availability; hands on the rows that differ."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price string, availability string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["recorded_at", "seq"], kind="stable")
        last = self.last.get() if self.last.exists() else None
        keep = []
        for price, availability in zip(batch["price"], batch["availability"], strict=True):
            now = (str(price), availability)
            keep.append(last is None or tuple(last) != now)
            last = now
        self.last.update(last)
        yield batch[keep][["series_id", "recorded_at", "seq", "price", "availability"]]

    def close(self) -> None:
        pass


def change_only(obs: DataFrame) -> DataFrame:
    """A stream of HISTORY rows without those that repeat their series' last price and availability.

    Within a micro-batch rows go by (recorded_at, seq); what comes later is appended as it arrives, without a watermark.
    """
    return obs.groupBy("series_id").transformWithStateInPandas(_Changes(), outputStructType=HISTORY, outputMode="Append", timeMode="None")


class _Health(StatefulProcessor):
    """Keeps the last statuses of each store, newest first."""

    limit = 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "statuses string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "result_id"], kind="stable")
        before = self.last.get()[0].split(",") if self.last.exists() else []
        statuses = [*reversed(batch["status"].tolist()), *before][: self.limit]
        self.last.update((",".join(statuses),))
        ok = [s not in UNHEALTHY for s in statuses]
        yield pd.DataFrame({"store_id": [key[0]], "total": [len(ok)], "healthy": [sum(ok)], "failing_in_a_row": [ok.index(True) if True in ok else len(ok)]})

    def close(self) -> None:
        pass


def store_health(results: DataFrame) -> DataFrame:
    """Each store's health over its last 20 results, anew whenever one comes in."""
    return results.groupBy("store_id").transformWithStateInPandas(_Health(), outputStructType="store_id long, total long, healthy long, failing_in_a_row long", outputMode="Update", timeMode="None")


def alert_stream(offers: DataFrame, alerts: DataFrame) -> DataFrame:
    """Offers of a stream at or below the target of a (static) enabled alert."""
    return firing(alerts, offers)


def snapshot_writer(obs: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], run: str = "run_id", seq: str = "seq") -> DataStreamWriter:
    """Applies each micro-batch to the current snapshot: `read` gives the last version, `write` stores the next.

    The snapshot keeps the run and place of each row. Of a key's rows, those before included, the latest run's count, and of these the one in stock, then the cheaper,
    then the first by `seq`: the greatest in one order, so the result is the same however runs are split over micro-batches and in whatever order these come.
    """

    def best(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in KEY]
        order = F.struct(F.col(run), (F.col("availability") == "in_stock").alias("there"), (-F.col("price")).alias("cheap"), (-F.col(seq)).alias("first"))
        return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("x"), F.min("first_seen_at").alias("__first"), F.max("last_seen_at").alias("__last")).select(
            *KEY, *[F.col("x")[c].alias(c) for c in rest if c not in ("first_seen_at", "last_seen_at")], F.col("__first").alias("first_seen_at"), F.col("__last").alias("last_seen_at")
        )

    def apply(batch: DataFrame, number: int) -> None:
        old, now = read(), F.current_timestamp()
        new = batch.withColumns({"first_seen_at": now, "last_seen_at": now})
        write(best(new if old is None else old.select(*new.columns).unionByName(new)), number)

    return obs.writeStream.foreachBatch(apply).outputMode("update")


class _Folded(StatefulProcessor):
    """Keeps a key's events in a map under their order and, when some come, folds all of them in that order.

    The outcome is that of all events so far, whatever came first. A key's state grows by one entry for each of its events that counts (`place` gives equal
    places to events of which one replaces the other, `better` says which).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "place string", "event string")

    def place(self, event: dict) -> list:
        raise NotImplementedError

    def better(self, old: dict, new: dict) -> bool:
        raise NotImplementedError

    def fold(self, key, events: list[dict]) -> list[dict]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for event in json.loads(batch.to_json(orient="records", date_format="iso", double_precision=15)):
                place = (json.dumps(self.place(event)),)
                if not self.events.containsKey(place) or self.better(json.loads(self.events.getValue(place)[0]), event):
                    self.events.updateValue(place, (json.dumps(event),))
        events = sorted(((json.loads(p[0]), json.loads(e[0])) for p, e in self.events.iterator()), key=lambda x: x[0])
        found = self.fold(key, [e for _, e in events])
        if found:
            yield pd.DataFrame(found)

    def close(self) -> None:
        pass


#: A queue's events: finds (with the candidate's fields) and decisions (confirmed or rejected), each with its run and place.
QUEUE_EVENT = "perfume_id long, store_id long, product_url string, run_id long, seq long, decision string, candidate_name string, price string, match_score double"
QUEUE_ROW = "perfume_id long, store_id long, product_url string, candidate_name string, price string, match_score double, status string, first_run long, last_run long, resolved_run long"


class _Queue(_Folded):
    def place(self, event):
        return [event["run_id"], event["seq"]]

    def better(self, old, new):
        return False  # an event that comes again

    def fold(self, key, events):
        row = None
        for e in events:
            if e["decision"] is None:
                if row is None:
                    row = {"status": "pending", "first_run": e["run_id"], "resolved_run": None}
                if row["status"] == "pending":
                    row |= {c: e[c] for c in ("candidate_name", "price", "match_score")} | {"last_run": e["run_id"]}
            elif row is not None and row["status"] == "pending":
                row |= {"status": e["decision"], "resolved_run": e["run_id"]}
        if row is None:
            return []
        row |= {"perfume_id": key[0], "store_id": key[1], "product_url": key[2]}
        return [{c: row[c] for c in (x.split()[0] for x in QUEUE_ROW.split(", "))}]


def review_queue(events: DataFrame) -> DataFrame:
    """QUEUE_EVENT rows to the queue's rows (QUEUE_ROW), anew for each key whenever events of it come.

    A find enters as pending and, while that lasts, takes the fields of each later one; the first decision after a find ends it. Order is (run_id, seq),
    not arrival: a decision or a find that comes late changes the outcome as if it had come in its place. A decision before any find does nothing.
    """
    return events.groupBy("perfume_id", "store_id", "product_url").transformWithStateInPandas(_Queue(), outputStructType=QUEUE_ROW, outputMode="Update", timeMode="None")


TRIGGER = "variant_id long, alert_id long, last_triggered_run long, last_triggered_price string"


class _Triggers(_Folded):
    """Offers of a variant by run and store; alerts of the variant come with each of them as a list of (id, target)."""

    def place(self, event):
        return [event["run_id"], event["store_id"]]

    def better(self, old, new):
        rank = lambda e: (e["availability"] != "in_stock", Decimal(e["price"]), e["seq"])
        return rank(new) < rank(old)

    def fold(self, key, events):
        now, fired = {}, {}
        for n, e in enumerate(events):
            now[e["store_id"]] = e
            if n + 1 < len(events) and events[n + 1]["run_id"] == e["run_id"]:
                continue  # the run's other stores come first
            there = [Decimal(x["price"]) for x in now.values() if x["availability"] == "in_stock"]
            for alert in e["alerts"] or []:
                if there and min(there) <= Decimal(alert["target"]):
                    fired[alert["id"]] = {"variant_id": key[0], "alert_id": alert["id"], "last_triggered_run": e["run_id"], "last_triggered_price": str(min(there))}
        return list(fired.values())


def alert_triggers(offers: DataFrame, alerts: DataFrame) -> DataFrame:
    """Offers (variant_id, store_id, run_id, seq, price, availability) to the persisted triggers (TRIGGER) of (static) enabled alerts, whenever a variant gets offers.

    After each run of a variant its stores' latest offers are looked at: an alert fires where the cheapest one in stock is at or below its target, and keeps
    the run and price of the last time. Order is by run, not arrival; of a store's offers of one run the one in stock, then the cheaper, then the first counts.
    """
    targets = alerts.where("enabled").groupBy("variant_id").agg(F.collect_list(F.struct(F.col("alert_id").alias("id"), F.col("target_price").cast("string").alias("target"))).alias("alerts"))
    rows = offers.select("variant_id", "store_id", "run_id", "seq", F.col("price").cast("string").alias("price"), "availability").where("price IS NOT NULL").join(targets, "variant_id")
    return rows.groupBy("variant_id").transformWithStateInPandas(_Triggers(), outputStructType=TRIGGER, outputMode="Update", timeMode="None")
