"""Training-data operators: tokenising, packing, near-duplicate search, chat
formatting, language-model scoring and quality classification. Nothing outside
this subpackage imports it."""
