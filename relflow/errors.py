"""Faults of workflows, raised before any Spark job runs."""


class WorkflowFault(Exception):
    """Any fault of a workflow."""


class SyntaxFault(WorkflowFault):
    """The text is no program."""


class AnalysisFault(WorkflowFault):
    """A name, ordinal, arity or type does not fit."""
