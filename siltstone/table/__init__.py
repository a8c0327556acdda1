"""The table layer: tables of Parquet files with a declared schema, atomic commits and snapshots."""

from siltstone.table.errors import AmbiguousCommitError, CommitConflict, ConcurrentModificationException, CorruptDataError, GarbageCollectionAborted, TableExistsError
from siltstone.table.files import DataFile
from siltstone.table.predicates import FilterExpression, FilterOp, parse_filter_dict
from siltstone.table.table import Table, create_table, load_table
from siltstone.table.transaction import Transaction, TransactionManager
from siltstone.table.types import Field, PartitionField, PartitionSpec, Schema, SortField, SortOrder

__all__ = [
    "AmbiguousCommitError", "CommitConflict", "ConcurrentModificationException", "CorruptDataError", "DataFile", "Field", "FilterExpression", "FilterOp", "GarbageCollectionAborted",
    "PartitionField", "PartitionSpec", "Schema", "SortField", "SortOrder", "Table", "TableExistsError", "Transaction", "TransactionManager", "create_table", "load_table", "parse_filter_dict",
]
