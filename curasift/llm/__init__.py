"""Operators for preparing training data: URL filters, decontamination, language-model
scoring, sharding, subword sampling, deduplication, chat formatting, quality rules and
toxicity.  Nothing outside this subpackage imports it."""
