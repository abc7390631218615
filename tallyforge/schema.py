"""The stored tables."""

from __future__ import annotations

TABLES = {
    "vendors": "vendor_id string, vendor_name string, vendor_name_normalized string, erp_source string, ord bigint",
    "invoices": "id bigint, invoice_id string, vendor_id string, vendor_name string, invoice_date date, due_date date, amount double, currency string, department string, po_number string, payment_status string, erp_source string, is_anomaly int, anomaly_type string, source string, imported_at timestamp",
    "detection_results": "invoice_row_id bigint, final_score double, risk_category string, flags string, detected_at timestamp",
    "receipt_checks": "id bigint, checked_at timestamp, source string, file_name string, invoice_id string, vendor_name string, invoice_date string, amount double, currency string, final_score double, risk_category string, flags string, tamper_score double, verdict string, checked_by string",
}
DEFAULTS = {"currency": "USD", "payment_status": "pending"}
