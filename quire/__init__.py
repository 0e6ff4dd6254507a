"""quire: a PySpark-native engine over corpora of e-books.

Books are tables (books, metadata, items, spine, toc, guide, page_list); the
operators are DataFrame transformations over those tables, the container format
is a pair of Spark data sources, and everything else is left to Catalyst.
"""
