"""All registered queries."""

from . import q_audit, q_documents, q_export, q_failures, q_findings, q_people, q_runs, q_states, q_stored  # noqa: F401
from .register import REGISTER

__all__ = ["REGISTER"]
