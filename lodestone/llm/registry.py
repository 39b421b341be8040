"""The queries of this subpackage, by the name under which they are checked."""

from __future__ import annotations

from . import bytebpe, chat, decontaminate, langid, quality, sharding, simhash, tokencount, tokenio, warc

_QUERIES = {
    "op1_simhash": simhash.query,
    "op2_sharding": sharding.query,
    "op3_tokencount": tokencount.query,
    "op4_decontaminate": decontaminate.query,
    "op5_tokenio": tokenio.query,
    "op6_chat": chat.query,
    "op7_quality": quality.query,
    "op8_bytebpe": bytebpe.query,
    "op9_warc": warc.query,
    "op10_langid": langid.query,
}
_SQL = {
    "op6_chat": chat.SQL,
    "op9_warc": warc.SQL,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
