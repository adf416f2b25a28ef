"""Parameters of the broker's operators; an invalid value fails when the object is made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class AuthKey:
    tenant: str
    salt: str
    hash: str
    scopes: frozenset[str] = frozenset()


@dataclass(frozen=True)
class BrokerConfig:
    """Durations are in milliseconds."""

    http_host: str = "0.0.0.0"
    http_port: int = 8080
    grpc_host: str = "0.0.0.0"
    grpc_port: int = 8081
    database: str = "journal"
    migrate_on_start: bool = True
    migrate_max_wait_ms: int = 30_000
    ack_deadline_ms: int = 30_000
    sweep_interval_ms: int = 5_000
    max_delivery_attempts: int = 5
    dead_letter_topic: str | None = None
    default_ttl_ms: int = 0
    dedup_window_ms: int = 0
    activity_window_ms: int = 60_000
    snapshot_every: int = 100
    keep_snapshots: int = 2
    poll_interval_ms: int = 1_000
    stream_batch: int = 100
    default_pull: int = 10
    auth_enabled: bool = False
    default_tenant: str = "default"
    auth_keys: tuple[AuthKey, ...] = ()
    seeds: tuple[str, ...] = field(default=())

    def __post_init__(self):
        topic = (self.dead_letter_topic or "").strip()
        object.__setattr__(self, "dead_letter_topic", topic or None)
        for name in ("http_port", "grpc_port"):
            if not 1 <= getattr(self, name) <= 65_535:
                raise ValueError(f"{name} has to be from 1 to 65535")
        for name in ("ack_deadline_ms", "sweep_interval_ms", "snapshot_every", "keep_snapshots", "poll_interval_ms", "stream_batch"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} has to be positive")
        for name in ("migrate_max_wait_ms", "max_delivery_attempts", "default_ttl_ms", "dedup_window_ms", "activity_window_ms"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")
        if not self.database.strip() or not self.http_host.strip() or not self.grpc_host.strip():
            raise ValueError("database and hosts can't be blank")
        if not self.default_tenant.strip() or "~" in self.default_tenant:
            raise ValueError("default_tenant can't be blank or hold ~")
        if self.auth_enabled and not self.auth_keys:
            raise ValueError("auth needs keys")
        for k in self.auth_keys:
            if not (k.tenant.strip() and k.salt.strip() and k.hash.strip()) or "~" in k.tenant:
                raise ValueError("a key needs a tenant without ~, a salt and a hash")

    @staticmethod
    def seeds_of(value: str | None, own: str) -> tuple[str, ...]:
        """Comma-separated seed nodes; the own address if none are named."""
        return tuple(x.strip() for x in (value or "").split(",") if x.strip()) or (own,)

    @classmethod
    def from_env(cls, prefix: str = "TIDEMARK_", env: dict[str, str] | None = None) -> BrokerConfig:
        env = dict(os.environ) if env is None else env
        made = {}
        for name, kind in (("http_port", int), ("grpc_port", int), ("ack_deadline_ms", int), ("sweep_interval_ms", int), ("max_delivery_attempts", int), ("dead_letter_topic", str), ("default_ttl_ms", int), ("dedup_window_ms", int), ("activity_window_ms", int), ("snapshot_every", int), ("keep_snapshots", int), ("database", str)):
            if (v := env.get(prefix + name.upper())) is not None:
                made[name] = kind(v)
        return cls(**made)
