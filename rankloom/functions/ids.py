"""Identifiers, normalised names and links of paper records, as column expressions.

NULL text counts as '' everywhere: the record type has no NULL strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and addresses that results must show.
ARXIV_DOI = "10.48550/arxiv."
ARXIV_PAGE, DOI_PAGE = "https://arxiv.org/abs/", "https://doi.org/"
SCHOLAR, DATASET_SEARCH = "https://scholar.google.com/scholar?q=", "https://huggingface.co/datasets?search="
SIZE_SUFFIX = r"(\d+k|\d+m|full|small|large|v\d+)$"
#: Everything but letters, digits and the underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"


#: White space of any kind, as a character class.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_version(arxiv_id: Column) -> Column:
    return F.regexp_replace(arxiv_id, r"v\d+$", "")


def norm_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(text(title)), NON_WORD, "")


def identifiers(doi: Column | str = "doi", arxiv_id: Column | str = "arxiv_id", title: Column | str = "title") -> Column:
    """doi:, arxiv: and title: identifiers in that order. A preprint's own DOI gives its arXiv id instead."""
    d, a = F.lower(text(doi)), strip_version(text(arxiv_id))
    own = d.startswith(ARXIV_DOI)
    arxiv = F.when(own & (a == ""), F.substring(d, len(ARXIV_DOI) + 1, 10_000)).otherwise(a)
    return F.array_compact(
        F.array(
            F.when(~own & (d != ""), F.concat(F.lit("doi:"), d)),
            F.when(arxiv != "", F.concat(F.lit("arxiv:"), F.lower(arxiv))),
            F.concat(F.lit("title:"), F.substring(norm_title(text(title)), 1, 80)),
        )
    )


def key(doi: Column | str = "doi", arxiv_id: Column | str = "arxiv_id", title: Column | str = "title") -> Column:
    return F.element_at(identifiers(doi, arxiv_id, title), 1)


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(text(name)), "[^a-z0-9]", "")


def base_name(norm: Column) -> Column:
    """The name without one trailing size or version."""
    return F.regexp_replace(norm, SIZE_SUFFIX, "")


def dataset_search(name: Column) -> Column:
    """Search link with the name percent-encoded as a path ('/' and '~' stay)."""
    q = F.url_encode(text(name))
    for found, put in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        q = F.replace(q, F.lit(found), F.lit(put))
    return F.concat(F.lit(DATASET_SEARCH), q)


def paper_url(url: Column, paper_key: Column, title: Column) -> Column:
    kind, rest = F.substring_index(paper_key, ":", 1), F.regexp_replace(paper_key, "^[^:]*:?", "")
    return (
        F.when(text(url) != "", url)
        .when(kind == "arxiv", F.concat(F.lit(ARXIV_PAGE), rest))
        .when(kind == "doi", F.concat(F.lit(DOI_PAGE), rest))
        .otherwise(F.concat(F.lit(SCHOLAR), F.replace(text(title), F.lit(" "), F.lit("+"))))
    )


def has_code(code_url: Column | str = "code_url") -> Column:
    return text(code_url) != ""


def paper_text(title: Column | str = "title", abstract: Column | str = "abstract") -> Column:
    return strip(F.concat(text(title), F.lit(". "), text(abstract)))


def text_hash(t: Column) -> Column:
    return F.substring(F.sha1(t.cast("binary")), 1, 16)


def snapshot_id(filename: Column) -> Column:
    """The 12 hexadecimal digits after the last dash of a snapshot's file name, else NULL."""
    m = F.regexp_extract(filename, r"-([0-9a-f]{12})\.json$", 1)
    return F.when(m != "", m)
