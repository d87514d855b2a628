"""Run decisions on logs that are still being written."""
