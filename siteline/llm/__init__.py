"""Operations of a training-data pipeline: filtering, search, deduplication, scoring and mixing of text tables.

Nothing outside this subpackage imports it.
"""
