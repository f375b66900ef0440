"""Security posture analytics over tables of collected web data, on PySpark."""

from webposture.plans.scan import Collected, ScanOptions, ScanReport, run_scans

__all__ = ["Collected", "ScanOptions", "ScanReport", "run_scans"]
