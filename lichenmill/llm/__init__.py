"""Training-data operators: mixing, token files, quality, language model, packing,
secrets, exact and near duplicates, nearest neighbours and chat formatting.

Nothing else in the library imports this subpackage.
"""
