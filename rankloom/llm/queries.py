"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canon, leaks, link, neighbours, spam, survivor, tokens, visual
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: canon.found(table(s, d, "scores"), table(s, d, "datasets")),
        "p2_found": lambda s, d: link.found(table(s, d, "papers"), table(s, d, "works"), table(s, d, "dup_groups")),
        "p2_links": lambda s, d: link.link(table(s, d, "papers"), table(s, d, "works"), table(s, d, "dup_groups")),
        "p3_found": lambda s, d: visual.found(table(s, d, "papers")),
        "p3_keys": lambda s, d: visual.keys(table(s, d, "papers")),
        "p4_found": lambda s, d: neighbours.found(table(s, d, "vecs")),
        "p5_found": lambda s, d: survivor.found(table(s, d, "papers"), table(s, d, "dup_groups")),
        "p6_ids": lambda s, d: tokens.encode_column(table(s, d, "documents"), "doc_id", "text"),
        "p7_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_found": lambda s, d: spam.found(table(s, d, "documents")),
    }


# What makes a field a case, as patterns: characters that can't be seen or are spaces of their own, forms of letters
# and signs, letters of two scripts in one word (or a whole word of look-alikes amid Latin text), a small Greek letter
# amid small Latin ones. Code points of look-alikes (all, without the Greek symbols; those that are exact).
_LIKE = (
    r"\x{405}\x{406}\x{408}\x{410}\x{412}\x{415}\x{41a}\x{41c}-\x{41e}\x{420}-\x{423}\x{425}\x{42c}\x{430}\x{435}\x{43e}\x{440}\x{441}\x{443}\x{445}\x{455}\x{456}\x{458}\x{4bb}\x{4cf}\x{501}\x{51b}\x{51d}"
    r"\x{391}\x{392}\x{395}-\x{397}\x{399}\x{39a}\x{39c}\x{39d}\x{39f}\x{3a1}\x{3a4}\x{3a5}\x{3a7}\x{3bf}\x{3f2}\x{3f3}"
    r"\x{555}\x{54d}\x{570}\x{578}\x{57d}\x{581}\x{585}\x{13a0}-\x{13a2}\x{13aa}-\x{13ac}\x{13b3}\x{13b7}\x{13bb}\x{13c0}\x{13c3}\x{13d9}\x{13da}\x{13de}\x{13df}\x{13e2}\x{13e6}\x{13f4}"
)
_EXACT = (
    r"\x{405}\x{406}\x{408}\x{410}\x{412}\x{415}\x{41a}\x{41c}-\x{41e}\x{420}-\x{422}\x{425}\x{430}\x{435}\x{43e}\x{440}\x{441}\x{443}\x{445}\x{455}\x{456}\x{458}"
    r"\x{391}\x{392}\x{395}-\x{397}\x{399}\x{39a}\x{39c}\x{39d}\x{39f}\x{3a1}\x{3a4}\x{3a7}\x{3bf}"
)
_SYMBOL = r"\x{3b1}\x{3b9}\x{3ba}\x{3bd}\x{3c1}\x{3c4}\x{3c5}\x{3c7}"
_HIDDEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}]"
_SPACE = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FORM = r"[\x{ff01}-\x{ff9f}\x{1d400}-\x{1d7ff}\x{fb00}-\x{fb06}\x{2010}\x{2011}\x{2026}]"
_MIXED = rf"\p{{Latin}}[\p{{L}}\p{{M}}]*[{_LIKE}]|[{_LIKE}][\p{{L}}\p{{M}}]*\p{{Latin}}|[a-z{_LIKE}][{_SYMBOL}][a-z{_LIKE}]|(?:^|[^\p{{L}}\p{{M}}])[{_SYMBOL}][a-z{_LIKE}]{{3}}"
_WHOLE = rf"(^|[^\p{{L}}\p{{M}}])[{_EXACT}]+($|[^\p{{L}}\p{{M}}])"
_LATIN = r"2*length(regexp_replace({0},'\P{{Latin}}','','g'))>=length(regexp_replace({0},'\P{{L}}','','g'))"


def _case_sql(c: str) -> str:
    t = f"nfc_normalize(regexp_replace(regexp_replace({c},'{_HIDDEN}','','g'),'{_SPACE}',' ','g'))"
    return f"(regexp_matches({c},'{_HIDDEN}|{_SPACE}|{_FORM}') or nfc_normalize({c})<>{c} or regexp_matches({t},'{_MIXED}') or (regexp_matches({t},'{_WHOLE}') and {_LATIN.format(t)}))"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": " union all ".join(f"select rec_id, '{c}' col from papers where {c} is not null and {_case_sql(c)}" for c in ("title", "abstract")),
    }
