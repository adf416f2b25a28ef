"""A client in the same process: one request a call, for applications that hold a broker."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .broker import Broker


class BrokerError(Exception):
    """A refused request: ``outcome``, and its REST and RPC status."""

    def __init__(self, outcome: str, rest: int, rpc: str):
        super().__init__(f"{outcome} ({rest}, {rpc})")
        self.outcome, self.rest, self.rpc = outcome, rest, rpc


class Client:
    def __init__(self, broker: Broker, token: str | None = None, clock: Callable[[], str] | None = None):
        self.broker, self.token = broker, token
        self.clock = clock or (lambda: datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f"))

    def _one(self, schema: str, *row):
        key = f"Bearer {self.token}" if self.token else None
        return self.broker.spark.createDataFrame([(*row, 0, key)], f"{schema}, position long, authorization string")

    @staticmethod
    def _checked(row):
        if row["status"]["rest"] >= 400:
            raise BrokerError(row["outcome"], *row["status"])
        return row

    def _topic(self, topic_id: str, kind: str, labels: dict | None = None) -> None:
        self._checked(self.broker.topic_command(self._one("topic_id string, kind string, labels map<string,string>", topic_id, kind, labels)).first())

    def create_topic(self, topic_id: str, labels: dict | None = None) -> None:
        self._topic(topic_id, "Create", labels or {})

    def update_topic(self, topic_id: str, labels: dict) -> None:
        self._topic(topic_id, "Update", labels)

    def delete_topic(self, topic_id: str) -> None:
        self._topic(topic_id, "Delete")

    def get_topic(self, topic_id: str) -> dict:
        """The labels of an active topic."""
        who = self.broker.admitted(self._one("topic_id string", topic_id)).first()
        if who["refusal"]:
            raise BrokerError(who["refusal"], 401, "UNAUTHENTICATED")
        found = self.broker.get_topic(who["tenant"]).where(F.col("topic_id") == topic_id).first()
        if found is None:
            raise BrokerError("TopicNotFound", 404, "NOT_FOUND")
        return found["labels"]

    def publish(self, topic_id: str, payload: bytes | str, attributes: dict | None = None) -> str:
        """The message's id."""
        row = self._one("topic_id string, message_id string, payload binary, attributes map<string,string>", topic_id, str(uuid.uuid4()), payload.encode() if isinstance(payload, str) else payload, attributes or {})
        return self._checked(self.broker.publish(row, self.clock()).first())["message_id"]

    def create_subscription(self, subscription_id: str, topic_id: str) -> None:
        self._checked(self.broker.create_subscription(self._one("subscription_id string, topic_id string", subscription_id, topic_id)).first())

    def pull(self, subscription_id: str, max: int = 10) -> list:
        return self._checked(self.broker.pull(self._one("subscription_id string, max int", subscription_id, max), self.clock()).first())["messages"]

    def ack(self, subscription_id: str, ack_ids: list[str]) -> list[str]:
        """The ids that were outstanding."""
        if not ack_ids:
            return []
        key = f"Bearer {self.token}" if self.token else None
        rows = self.broker.spark.createDataFrame([(subscription_id, a, i, key) for i, a in enumerate(ack_ids)], "subscription_id string, ack_id string, position long, authorization string")
        return self._checked(self.broker.acknowledge(rows, rpc=True).first())["applied"]
