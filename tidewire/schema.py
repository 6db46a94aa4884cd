"""Column names and schemas of the news-article data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names, their positional order, the dropped-column list
# and the output column orders must equal the reference's data layout.
# ---------------------------------------------------------------------------

#: the 27 positional columns of a raw knowledge-graph drop (tab separated)
RAW_COLUMNS = (
    "GKGRECORDID", "V2.1DATE", "V2SOURCECOLLECTIONID", "V2SOURCECOMMONNAME",
    "V1DOCUMENTIDENTIFIER", "V1COUNTS", "V2.1COUNTS", "V1THEMES", "V2ENHANCEDTHEMES",
    "V1LOCATIONS", "V2ENHANCEDLOCATIONS", "V1PERSONS", "V2ENHANCEDPERSONS",
    "V1ORGANIZATIONS", "V2ENHANCEDORGANIZATIONS", "V1.5TONE", "V2.1ENHANCEDDATES",
    "V2GCAM", "V2.1SHARINGIMAGE", "V2.1RELATEDIMAGES", "V2.1SOCIALIMAGEEMBEDS",
    "V2.1SOCIALVIDEOEMBEDS", "V2.1QUOTATIONS", "V2.1ALLNAMES", "V2.1AMOUNTS",
    "V2.1TRANSLATIONINFO", "V2EXTRASXML",
)


#: columns the parser drops (current profile); one name does not exist in the
#: raw schema and is ignored like the reference ignores it
DROPPED_COLUMNS = (
    "V2.1TRANSLATIONINFO", "V2.1COUNTS", "V2SOURCECOLLECTIONID", "V2EXTRASXML",
    "V2.1QUOTATIONS", "V2ENHANCEDPERSONS", "V2.1SOCIALVIDEOEMBEDS", "V2.1ALLNAMES",
    "V2.1AMOUNTS", "V2.1SOCIALIMAGEEMBEDS", "V2.1RELATEDIMAGES", "V1COUNTS", "V2GCAM",
    "V2.1SHARINGIMAGE", "V2.1ENHANCEDDATES", "V1PERSONS", "V2.1DATE",
    "V2SOURCECOLLECTIONIDENTIFIER",
)

#: the 10 columns a parsed record keeps, in raw order
PARSED_COLUMNS = tuple(c for c in RAW_COLUMNS if c not in DROPPED_COLUMNS)

#: priority order of the enriched article (the rest follow in input order)
ENRICHED_FIRST = (
    "date", "tone", "daily_avg_tone", "london_mentions", "crime_mentions",
    "crime_keyword_count", "crime_types", "headline", "headline_is_duplicate",
    "V1DOCUMENTIDENTIFIER", "V2ENHANCEDTHEMES", "V2SOURCECOMMONNAME",
)

#: priority order of a CSV enriched with headlines only
CSV_ENRICH_FIRST = (
    "date", "tone", "daily_avg_tone", "crime_mentions", "headline",
    "V1DOCUMENTIDENTIFIER", "V2ENHANCEDTHEMES", "V2SOURCECOMMONNAME",
)

#: text columns upper-cased (nulls -> '') before filtering
FILTER_TEXT_COLUMNS = ("V2ENHANCEDTHEMES", "V1LOCATIONS", "V2ENHANCEDLOCATIONS", "V2SOURCECOMMONNAME")

#: numeric columns coerced by the monthly cleaning job
CLEAN_NUMERIC_COLUMNS = ("tone", "daily_avg_tone", "london_mentions", "crime_mentions",
                         "crime_keyword_count")

#: marker stored in the headline cache for a page without a title
MISSED_HEADLINE = "__MISSED HEADLINE__"

RID, DATE, SOURCE, URL, HEADLINE = ("GKGRECORDID", "date", "V2SOURCECOMMONNAME",
                                    "V1DOCUMENTIDENTIFIER", "headline")
DUP, TYPES, TYPE = "headline_is_duplicate", "crime_types", "crime_type"
