"""Training-data operators: mixing, personal data, quality rules, secret scans,
decontamination, line dedup, URL filters, SimHash dedup, HTML extraction and
token counts.  Nothing else in the library imports this subpackage.
"""
