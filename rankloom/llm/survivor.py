"""Problem 5: the best record of each duplicate group, field by field.

Skyline selection. Every record of a group has three dimensions: completeness (of its abstract, citations, code and
venue those that are usable), recency (the month in which its source was asked) and trust (the authors' code, an
identifier). The records that no other one dominates are the first layer of the group, those that only they dominate
the second, and so on. A field is taken from the first layer that has a usable value for it, nulls being filled from
the layers behind; what the field itself demands (the longest own text, the newest count, the authors' repository,
the venue in full) comes before the layer in the lexicographic policy, as the survivor of a field is defined by it.

Layers are numbered on the different triples of a group. There are at most 5 x 3 of them a month, whatever the size
of the group; records and values are only ever aggregated, with map-side combine, so that no task gathers a group.

Defined results: groups without a usable value in a field give no row for it; NULL, '' and blanks are unusable;
records of the same value count as one, of the smallest rec_id; repeated rows change nothing; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .visual import normalize_columns

#: A sentence found in so many different papers, or under so many titles, is no paper's own text; titles count only
#: if they belong to SHARED_PAPERS papers, as one paper's title may be spelled in many ways.
SHARED_SENTENCE, SHARED_PAPERS = 4, 3
#: Rows of a side (hashes of shared sentences, layers) up to which it is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 200_000
FIELDS = ("abstract", "citations", "code_url", "venue")
# What sources write where they have nothing.
NO_ABSTRACT = "null|none|nan|n/?a|tbd|-+|\\?+|\\[?abstract (?:is )?(?:missing|not available|unavailable)\\]?|no abstract(?: available)?|see pdf(?: for abstract)?|kein abstract verfügbar|(?:kein|pas de) abstract"
NO_VENUE = "arxiv(?:\\.org)?(?: e-?prints?| preprint)?|corr|preprints?|unknown|none|null|n/?a|tbd|-+|\\?+|(?:bio|med|chem)rxiv|ssrn|research square|hal|self-published|submitted|under review|in press"
CUT_MARK = "\\s*(?:\\[(?:\\.\\.\\.|…)\\]|\\((?:truncated|cut|continued|more)\\)|\\.\\.\\.|…)\\s*"


def layers(records: DataFrame) -> DataFrame:
    """(group_id, completeness, recency, trust, layer): the dominance layer, from 1, of each different triple of a group.

    A triple lies one layer behind the last layer that holds a triple at least as good in all three dimensions. Sorted
    from the best completeness down, a triple comes after all that dominate it, so one pass numbers them.
    """
    dims = ("completeness", "recency", "trust")
    best_first = F.array_sort(F.collect_set(F.struct(*((-F.col(d)).cast("int").alias(d) for d in dims))))

    def place(done: Column, x: Column) -> Column:
        over = F.filter(done, lambda y: (y["completeness"] <= x["completeness"]) & (y["recency"] <= x["recency"]) & (y["trust"] <= x["trust"]))
        layer = F.coalesce(F.array_max(F.transform(over, lambda y: y["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(*(x[d].alias(d) for d in dims), layer.cast("int").alias("layer"))))

    none = F.array().cast("array<struct<completeness:int,recency:int,trust:int,layer:int>>")
    numbered = records.groupBy("group_id").agg(F.aggregate(best_first, none, place).alias("all"))
    return numbered.select("group_id", F.inline("all")).select("group_id", *((-F.col(d)).alias(d) for d in dims), "layer")


def survivors(values: DataFrame) -> DataFrame:
    """(group_id, col, rec_id) from usable values (group_id, col, value, rec_id, fit, size, seen, layer).

    The policy: the field's own demand (fit), then the layer, then the newest, then the larger, then the smallest rec_id.
    """
    merged = values.groupBy("group_id", "col", "value").agg(
        F.min("rec_id").alias("rec_id"), F.max("fit").alias("fit"), F.min("layer").alias("layer"), F.max("seen").alias("seen"), F.max("size").alias("size")
    )
    return merged.groupBy("group_id", "col").agg(F.max_by("rec_id", F.struct("fit", -F.col("layer"), "seen", "size", -F.col("rec_id"))).alias("rec_id"))


def own_text(records: DataFrame) -> DataFrame:
    """(rec_id, own): the sentences of each grouped abstract that are the paper's own, in order, without cut marks.

    Sentences shared by several papers (menus, notices) are found by counting over all records (rec_id, group_id,
    title_key, abstract_key). A group is one paper however its titles are spelled; records without a group (NULL)
    are one paper per title.
    """
    paper = F.when(F.col("group_id").isNotNull(), F.xxhash64(F.lit("group"), "group_id")).when(F.length("title_key") > 0, F.xxhash64(F.lit("title"), "title_key")).otherwise(F.xxhash64(F.lit("record"), "rec_id"))
    parts = records.select(
        "rec_id", "group_id", "title_key", paper.alias("paper"), F.posexplode(F.split(F.regexp_replace("abstract_key", CUT_MARK, "\u0001"), "(?<=[.!?])\\s+|\u0001")).alias("pos", "sentence")
    ).where(F.length("sentence") > 0).withColumn("h", F.xxhash64("sentence"))
    counts = parts.groupBy("h").agg(F.count_distinct("paper").alias("papers"), F.count_distinct("title_key").alias("titles"))
    shared = counts.where((F.col("papers") >= SHARED_SENTENCE) | (F.col("papers") >= SHARED_PAPERS) & (F.col("titles") >= SHARED_SENTENCE)).select("h")
    side = small(materialize(shared, "shared"), BROADCAST_ROWS)
    grouped = parts.where(F.col("group_id").isNotNull()).dropDuplicates(["rec_id", "pos"])
    own = grouped.join(side, "h", "left_anti").where(F.size(F.split("sentence", " ")) >= 2)
    return own.groupBy("rec_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("own")
    )


def repository(url: Column) -> Column:
    """host/owner/name of a link to a repository, else NULL."""
    u = F.regexp_replace(F.lower(F.trim(url)), "^(?:git\\+)?(?:https?|ssh|git)://(?:git@)?(?:www\\.)?", "")
    m = F.regexp_extract(u, "^([a-z0-9.-]+\\.[a-z]{2,}/[^/?#\\s]+/[^/?#\\s]+)", 1)
    linked = F.lower(F.trim(url)).rlike("^(?:git\\+)?(?:https?|ssh|git)://")
    return F.when(linked & (m != ""), F.regexp_replace(m, "\\.git$", ""))


def usable_fields(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, rec_id, seen, completeness, recency, trust, abstract, citations, code_url, venue) of every grouped record.

    Each field is a struct (value, fit, size), NULL if unusable.
    """
    member = groups.select("group_id", "rec_id").where(F.col("group_id").isNotNull() & F.col("rec_id").isNotNull()).distinct()
    cols = ["rec_id", "title", "abstract", "venue", "citations", "code_url", "code_official", "fetched_at"]
    marks = [F.length(F.trim(F.coalesce(c, F.lit("")))) > 0 for c in ("doi", "arxiv_id")]
    records = normalize_columns(papers.select(*cols, (marks[0] | marks[1]).alias("named")), ["title", "abstract", "venue", "code_url"])
    records = records.drop("title_visible", "abstract_visible", "code_url_key", *(f"{c}_case" for c in ("title", "abstract", "venue", "code_url")))
    every = materialize(records.join(member, "rec_id", "left").drop("title", "abstract", "venue", "code_url"), "records")
    own = own_text(every.select("rec_id", "group_id", "title_key", "abstract_key"))
    r = every.where(F.col("group_id").isNotNull()).drop("abstract_key").join(own, "rec_id", "left").dropDuplicates(["group_id", "rec_id"])

    def field(usable: Column, value: Column, fit: Column, size: Column) -> Column:
        return F.when(usable, F.struct(value.cast("string").alias("value"), fit.cast("long").alias("fit"), size.cast("long").alias("size")))

    none, seen = F.lit(0), F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(-1).cast("long"))
    bare = F.regexp_replace(F.trim("own"), "[.\\s]+$", "")
    is_text = ~bare.rlike(f"^(?:{NO_ABSTRACT})$") & (bare != F.regexp_replace(F.coalesce("title_key", F.lit("")), "[.\\s]+$", "")) & (F.size(F.split(bare, " ")) >= 3)
    n = F.col("citations")
    repo = repository(F.col("code_url_visible"))
    v = F.col("venue_key")
    cut = v.rlike("(?:\\.\\.\\.|…|\\[\\.\\.\\.\\]|\\(truncated\\))\\s*$")
    place = F.regexp_replace(F.regexp_replace(v, f"(?:{CUT_MARK})+$", ""), "[\\s,(]*(?:19|20)\\d\\d\\)?$", "")
    short = F.regexp_replace(v, "[.\\s]+$", "").rlike("\\.(?:\\s|$)") | v.rlike("\\.$") | v.rlike("[\\s,](?:19|20)\\d\\d$")
    is_place = (F.length(F.coalesce(v, F.lit(""))) > 0) & ~place.rlike(f"^(?:{NO_VENUE})$") & (F.length(place) > 1)
    out = r.select(
        "group_id", "rec_id", seen.alias("seen"), "named", F.coalesce("code_official", F.lit(False)).alias("official"),
        field(is_text, F.xxhash64(bare), F.length(bare), none).alias("abstract"),
        field((n > 0) & ~n.cast("string").rlike("^9{5,}$") & (n < 2147483647), n, seen, n).alias("citations"),
        field(repo.isNotNull(), repo, F.coalesce("code_official", F.lit(False)).cast("int"), none).alias("code_url"),
        field(is_place, place, F.when(cut, 1).when(short, 2).otherwise(3), none).alias("venue"),
    )
    filled = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    month = F.coalesce(F.months_between(F.timestamp_micros("seen"), F.lit("1970-01-01").cast("timestamp")).cast("int"), F.lit(0))
    trust = (F.col("official") & F.col("code_url").isNotNull()).cast("int") + F.col("named").cast("int")
    return out.select("group_id", "rec_id", "seen", *FIELDS, filled.alias("completeness"), F.when(F.col("seen") >= 0, month).otherwise(-1).alias("recency"), trust.alias("trust"))


def found(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, col, rec_id): the record whose value survives, for each group and field with a usable value."""
    records = materialize(usable_fields(papers, groups), "fields")
    placed = records.join(small(layers(records), BROADCAST_ROWS), ["group_id", "completeness", "recency", "trust"])
    each = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("f")) for c in FIELDS))
    values = placed.select("group_id", "rec_id", "seen", "layer", F.inline(each)).where(F.col("f").isNotNull())
    return survivors(values.select("group_id", "rec_id", "seen", "layer", "col", "f.*"))
