"""Newick scans: the first tree of each file, a row a node."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lichenmill.operators.tree import node_rows, parse_newick
from lichenmill.types import TREE

from .base import FileSource, expand_paths, is_stdin, open_bytes, scan


class NewickSource(FileSource):
    ddl = TREE

    @classmethod
    def name(cls):
        return "newick"

    @staticmethod
    def rows(files):
        with open_bytes(files[0]) as f:
            yield from node_rows(parse_newick(f.read().decode()))


def read_newick(spark, path, include_filepath: bool = False) -> DataFrame:
    """Nodes of Newick trees, gzip or not, with edge ids in braces; children come before their parents."""
    files = [path] if is_stdin(path) else expand_paths(path, "read_newick")
    return scan(spark, NewickSource, [(f,) for f in files], {}, include_filepath)
