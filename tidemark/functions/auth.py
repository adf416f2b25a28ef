"""Credentials: which token a request carries, and whose key it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def token(authorization: Column, api_key: Column) -> Column:
    """A bearer token goes before an API key."""
    return F.coalesce(F.when(authorization.startswith("Bearer "), F.substr(authorization, F.lit(8))), api_key)


def matches(token: Column, salt: Column, digest: Column) -> Column:
    """Whether a token's salted SHA-256 (salt and digest in base64) is the key's."""
    return F.unhex(F.sha2(F.concat(F.unbase64(salt), token.cast("binary")), 256)) == F.unbase64(digest)


def principals(tokens: DataFrame, keys: list, default_tenant: str | None = None) -> DataFrame:
    """``tokens`` (token, ...) with tenant, scopes and key position of the first key that matches; null if none does.

    Keys come from the configuration, so there are few; they are part of the plan, and tokens meet no shuffle.
    """
    t = F.col("token")
    tenant, scopes, position = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(keys))):
        hit = matches(t, F.lit(k.salt), F.lit(k.hash))
        tenant = F.when(hit, k.tenant).otherwise(tenant)
        scopes = F.when(hit, F.array(*[F.lit(s) for s in sorted(k.scopes)]).cast("array<string>")).otherwise(scopes)
        position = F.when(hit, i).otherwise(position)
    return tokens.withColumns({"tenant": tenant, "scopes": scopes, "key_position": position})


def allowed(scopes: Column, scope: str) -> Column:
    return F.coalesce(F.array_contains(scopes, scope), F.lit(False))
