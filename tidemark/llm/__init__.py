"""Training-data operators: language id, near-duplicate joins, license and secret scans, BPE, quality, WARC,
byte-level dedup, decontamination, language-model scoring, quality classification, periodic runs and ranked search.

Nothing else in the library imports this subpackage.
"""
