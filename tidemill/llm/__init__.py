"""Training-data operators: near-dedup, language ID, URL lists, packing, search, mixing, classifiers, chat formatting."""
