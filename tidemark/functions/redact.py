"""Secrets masked before anything is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and shapes of secrets, in the order they are masked in. Where the first group is not
# None, it is kept before the mask. A text without the hint has none.
SECRETS = [
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", False, "PRIVATE KEY-----"),
    ("aws-key-id", r"\bAKIA[0-9A-Z]{16}\b", False, "AKIA"),
    ("aws-secret", r"([Aa][Ww][Ss]_[Ss][Ee][Cc][Rr][Ee][Tt]_[Aa][Cc][Cc][Ee][Ss][Ss]_[Kk][Ee][Yy] *[=:] *(?:\\?[\"'])?)[A-Za-z0-9/+=]{40}", True, "aws_secret_access_key"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", False, "gh"),
    ("api-key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{32,}", False, "sk-"),
    ("slack-token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", False, "xox"),
    ("bearer-token", r"([Aa][Uu][Tt][Hh][Oo][Rr][Ii][Zz][Aa][Tt][Ii][Oo][Nn]: *[Bb][Ee][Aa][Rr][Ee][Rr] +)[A-Za-z0-9._~+/=-]{16,}", True, "authorization"),
]


def _step(pattern: str, mask: str, hint: str):
    def step(s: Column) -> Column:
        may = F.contains(F.lower(s["t"]), F.lit(hint.lower()))
        return F.struct(F.when(may, F.regexp_replace(s["t"], pattern, mask)).otherwise(s["t"]).alias("t"), (s["n"] + F.when(may, F.regexp_count(s["t"], F.lit(pattern))).otherwise(0)).alias("n"))

    return step


def redact(text: Column) -> tuple[Column, Column]:
    """(text with its secrets masked, how many were). Each shape is looked for in what the ones before left."""
    # Each step binds the one before as a lambda's variable, so that it is worked out once.
    state = F.struct(text.alias("t"), F.lit(0).alias("n"))
    for name, pattern, keeps, hint in SECRETS:
        mask = f"{'$1' if keeps else ''}[redacted {name}]"

        state = F.get(F.transform(F.array(state), _step(pattern, mask, hint)), 0)
    return state["t"], state["n"]
