"""Exceptions of the table layer."""


class CommitConflict(Exception):
    """Another writer published the version first."""


class ConcurrentModificationException(CommitConflict):
    """A commit kept losing against other writers, or its base was out of date."""


class AmbiguousCommitError(Exception):
    """It is not known whether the commit was published; its files are kept."""


class TableExistsError(Exception):
    """The table is there already."""


class CorruptDataError(Exception):
    """A file does not have the checksum recorded for it."""


class GarbageCollectionAborted(Exception):
    """Collection stopped, with nothing deleted, because not everything reachable could be read."""
