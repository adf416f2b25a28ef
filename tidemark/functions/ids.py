"""Identifiers: validation, tenants, derived ids, persistence ids and tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import TAGS


def trimmed(x: Column) -> Column:
    """Without characters up to the space at both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def valid(x: Column) -> Column:
    """Whether an id has anything but blanks."""
    return F.coalesce(F.length(trimmed(x)) > 0, F.lit(False))


def valid_tenant(x: Column) -> Column:
    return valid(x) & ~x.contains("~")


def qualify(tenant: Column, external: Column) -> Column:
    """The internal id of a tenant's resource. A null tenant (auth off) leaves the id as it is."""
    return F.when(tenant.isNull(), external).otherwise(F.concat(tenant, F.lit("~"), external))


def belongs(tenant: Column, internal: Column) -> Column:
    """Whether a resource is the tenant's; without a tenant, whether it is no tenant's."""
    return F.when(tenant.isNull(), ~internal.contains("~")).otherwise(F.startswith(internal, F.concat(tenant, F.lit("~"))))


def unqualify(tenant: Column, internal: Column) -> Column:
    """The external id, or the id itself if it isn't the tenant's."""
    return F.when(tenant.isNotNull() & belongs(tenant, internal), F.substr(internal, F.length(tenant) + 2)).otherwise(internal)


def valid_external(tenant: Column, external: Column) -> Column:
    """With tenants, an external id can't hold the separator."""
    return valid(external) & (tenant.isNull() | ~external.contains("~"))


def ack_id(subscription: Column, message: Column) -> Column:
    return F.concat_ws(":", subscription, message)


def dead_letter_id(subscription: Column, message: Column) -> Column:
    return F.concat_ws(":", F.lit("dead-letter"), subscription, message)


def persistence_id(kind: str, x: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), x)


def parsed(kind: str, pid: Column) -> Column:
    """The id in a persistence id of this kind; null unless there are exactly two parts."""
    parts = F.split(pid, r"\|", -1)
    return F.when((F.size(parts) == 2) & (F.get(parts, 0) == kind), F.get(parts, 1))


def tags(event_type: Column) -> Column:
    """The tags of an event type, in alphabetical order."""
    return F.filter(F.array(*[F.when(event_type.isin(types), F.lit(tag)) for tag, types in sorted(TAGS.items())]), lambda x: x.isNotNull())
