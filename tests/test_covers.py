"""Reports claim only what they run."""
from shelfwise.plans.registry import load_all


def test_written_reports_claim_what_they_run():
    reports = load_all()
    # One sheet, compressed whatever its size, by nation alone; an export and its retention, no file moves.
    assert set(reports["written_supplier_sheets"].covers) == {"S19", "S21"}
    assert set(reports["written_exports"].covers) == {"S24"}
