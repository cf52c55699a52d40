from .backends import BACKENDS, state_settings
from .batch_log import log_batches
from .builtin import BuiltinAggregate, BuiltinJob, OrderedFold, mean_aggregate
from .processor import ProcessorJob, PythonAggregate
from .savepoint import Savepoint, SavepointError
from .trial import Setup, savepoint_trial

__all__ = [
    "BACKENDS",
    "BuiltinAggregate",
    "BuiltinJob",
    "OrderedFold",
    "ProcessorJob",
    "PythonAggregate",
    "Savepoint",
    "SavepointError",
    "Setup",
    "log_batches",
    "mean_aggregate",
    "savepoint_trial",
    "state_settings",
]
