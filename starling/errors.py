"""Errors of the library; all are ValueErrors, raised on the driver before a query runs wherever that is possible."""


class StarlingError(ValueError):
    pass


class DimensionMismatch(StarlingError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected vectors of dimension {expected}, got {got}")


class DuplicateId(StarlingError):
    def __init__(self, id: str):
        super().__init__(f"id {id!r} exists already or twice")


class NotFound(StarlingError):
    def __init__(self, id: str):
        super().__init__(f"no record has id {id!r}")


class DatabaseNotFound(StarlingError):
    pass


class InvalidMetric(StarlingError):
    def __init__(self, name):
        super().__init__(f"unknown metric {name!r}; use cosine, euclidean (l2) or dot_product (dot)")


class InvalidFilter(StarlingError):
    pass


class InvalidVector(StarlingError):
    pass


class CorruptData(StarlingError):
    pass


class CollectionExists(StarlingError):
    pass


class InvalidCollectionName(StarlingError):
    pass


class Conflict(StarlingError):
    """Another writer changed the collection since it was opened."""
