"""colloquy: conversation-transcript analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from colloquy.session import build_session, scratch_path

# The few Python functions travel with their tasks, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_path"]
