"""Tables written to the folder that driver and executors share."""

from millrace.operators.storage import shared_folder, stored  # noqa: F401
