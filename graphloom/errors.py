"""Typed errors."""


class GraphError(Exception):
    """Base of all errors of this package."""


class ValidationError(GraphError):
    pass


class UnknownKindError(ValidationError):
    pass


class OntologyError(ValidationError):
    pass


class TemporalError(ValidationError):
    pass


class QueryError(ValidationError):
    pass


class UnsupportedPredicateError(QueryError):
    pass


class CursorError(QueryError):
    pass


class SchemaMismatchError(ValidationError):
    pass


class ConstraintViolation(GraphError):
    pass


class UniquenessError(ConstraintViolation):
    pass


class CardinalityError(ConstraintViolation):
    pass


class EndpointError(ConstraintViolation):
    pass


class DisjointnessError(ConstraintViolation):
    pass


class RestrictedDeleteError(ConstraintViolation):
    pass


class IdentityContradiction(GraphError):
    pass


class InvalidEdgeWeightError(GraphError):
    pass


class ConvergenceError(GraphError):
    pass


class OscillationError(ConvergenceError):
    pass


class MergeError(GraphError):
    pass


class ImportConflictError(GraphError):
    pass


class NodeNotFoundError(GraphError):
    pass
