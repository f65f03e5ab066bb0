"""Digests, deterministic ids, pseudonyms and canonical JSON."""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(prefix: str, *parts: Column, length: int = 32) -> Column:
    """prefix_ and the first hex digits of the SHA-256 of the parts; a null part differs from an empty one."""
    framed = F.concat_ws("\0", *(F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(framed, 256), 1, length))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null for a text that isn't JSON, that repeats a key or holds NaN."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(_):
        raise ValueError("not finite")

    out = []
    for t in text:
        try:
            out.append(None if t is None else json.dumps(json.loads(t, object_pairs_hook=once, parse_constant=refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        except (ValueError, RecursionError):
            out.append(None)
    return pd.Series(out, dtype=object)


def pseudonym(subject: Column, secret: bytes, prefix: str = "subj", namespace: str = "", fold: bool = False, length: int = 32) -> Column:
    """prefix_ and the first hex digits of an HMAC-SHA-256 of the trimmed NFKC form; the secret stays with the caller.

    A namespace tells equal subjects of different sources apart; fold takes upper and lower case for the same.
    """

    @F.pandas_udf(T.StringType())
    def keyed(s: pd.Series) -> pd.Series:
        def norm(x: str) -> bytes:
            bare = unicodedata.normalize("NFKC", x).strip()
            return (f"{namespace}\0" if namespace else "").encode() + (bare.casefold() if fold else bare).encode()

        return pd.Series([None if x is None else f"{prefix}_{hmac.new(secret, norm(x), hashlib.sha256).hexdigest()[:length]}" for x in s], dtype=object)

    return keyed(subject)


@F.pandas_udf(T.StringType())
def name_key(text: pd.Series) -> pd.Series:
    """A name without case, compatibility forms and repeated blanks."""
    return pd.Series([None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in text], dtype=object)
