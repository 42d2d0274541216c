"""Operators of a training-data pipeline over documents, pages and embeddings."""


def queries() -> dict:
    from . import bpe, collocations, exact_dedup, html_text, near_dedup, packing, quality, resampling, secret_scan, token_counts, token_files, topk_search, warc_zip

    modules = (html_text, exact_dedup, packing, near_dedup, token_files, bpe, token_counts, secret_scan, topk_search, quality, resampling, warc_zip, collocations)
    return {name: f for m in modules for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import collocations, exact_dedup, resampling, topk_search, warc_zip

    return {name: sql for m in (exact_dedup, topk_search, resampling, warc_zip, collocations) for name, sql in m.SQL.items()}
