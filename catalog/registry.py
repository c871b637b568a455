"""All registered queries."""

from catalog import features, loading, records, scores, stored, tables_out

QUERIES = [
    *records.QUERIES,
    *loading.QUERIES,
    *features.QUERIES,
    *scores.QUERIES,
    *tables_out.QUERIES,
    *stored.QUERIES,
]
