"""Small conversions between messages of tools and models, as plain functions and as columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.errors import ToolkitError


def to_content(output) -> list[dict]:
    """A tool's output as text blocks: a string as it is, anything else as JSON over several lines."""
    return [{"type": "text", "text": output if isinstance(output, str) else json.dumps(output, indent=2, ensure_ascii=False)}]


def from_content(result: dict):
    """What a remote tool's result means: an error is raised; structured content, one text, or the blocks come back."""
    blocks = result.get("content") or []
    if result.get("isError"):
        raise ToolkitError("MCP_TOOL_ERROR", "\n".join(b["text"] for b in blocks if b.get("type") == "text") or "the remote tool failed")
    if result.get("structuredContent") is not None:
        return result["structuredContent"]
    return blocks[0]["text"] if len(blocks) == 1 and blocks[0].get("type") == "text" else blocks


def block_text(content: Column) -> Column:
    """Texts of the text blocks of an array<struct<type, text>>, one after another; null content gives ''."""
    texts = F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def usage_or_zero(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


def bearer_token(header: str | None) -> str | None:
    found = re.match(r"^Bearer (.+)$", header or "", re.IGNORECASE)
    return found[1] if found else None


def bearer_column(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"(?i)^Bearer (.+)$", 1), F.lit(""))


def scopes_of(claims: dict) -> list[str]:
    """Scopes of token claims: ``scope`` split at blanks, else the texts in ``scopes``."""
    if isinstance(claims.get("scope"), str):
        return [s for s in claims["scope"].split(" ") if s]
    found = claims.get("scopes")
    return [s for s in found if isinstance(s, str)] if isinstance(found, list) else []


def scopes_column(scope: Column) -> Column:
    return F.filter(F.split(scope, " "), lambda s: s != "")


def missing_scopes(need: Column, have: Column) -> Column:
    """Scopes needed and not held, in the order of need; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_except(F.coalesce(need, none), F.coalesce(have, none))
