"""Three sample documents with the records a correct extraction gives."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Invented invoices, told as a ledger entry, a letter and a till slip.
SAMPLES = (
    (
        "ledger-entry",
        "No. 77/B of 3 March 2025, Okoro Observatory Works to be paid within the month (2 April 2025).\n"
        "Mirror recoating, one piece: 912.40 USD. Dome bearing grease, 5 tins at 18.30 USD: 91.50 USD.\n"
        "Together 1003.90 USD; no tax applies. Questions to desk@okoro-observatory.example.",
        {
            "invoice_number": "77/B", "vendor_name": "Okoro Observatory Works",
            "vendor_email": "desk@okoro-observatory.example", "invoice_date": "2025-03-03",
            "due_date": "2025-04-02", "currency": "USD",
            "line_items": [
                {"description": "Mirror recoating", "quantity": 1, "unit_price": 912.40, "amount": 912.40},
                {"description": "Dome bearing grease", "quantity": 5, "unit_price": 18.30, "amount": 91.50},
            ],
            "subtotal": 1003.90, "tax": 0, "total": 1003.90, "po_number": None, "status": "pending",
        },
    ),
    (
        "letter",
        "Dear Madam, for the harp we sent on your order ORD 5-31 we charge two thousand euros, and for its\n"
        "case 260 euros; with 21 percent tax (474.60) this makes 2734.60 euros, reference HRP-0019, 11.11.2024.\n"
        "Payment reached us the same day, thank you. Lievens Harpbouw",
        {
            "invoice_number": "HRP-0019", "vendor_name": "Lievens Harpbouw", "vendor_email": None,
            "invoice_date": "2024-11-11", "due_date": None, "currency": "EUR",
            "line_items": [
                {"description": "Harp", "quantity": 1, "unit_price": 2000.00, "amount": 2000.00},
                {"description": "Harp case", "quantity": 1, "unit_price": 260.00, "amount": 260.00},
            ],
            "subtotal": 2260.00, "tax": 474.60, "total": 2734.60, "po_number": "ORD 5-31", "status": "paid",
        },
    ),
    (
        "till-slip",
        "SALT MARSH NURSERY / slip 000482 / 19 Sep 2025\n"
        "sea lavender x7 3.15 ...... 22.05\nwillow stakes x30 0.85 ..... 25.50\n"
        "delivery ................... 9.00\nsum 56.55 incl. nothing; GBP; due 3 Oct 2025",
        {
            "invoice_number": "000482", "vendor_name": "Salt Marsh Nursery", "vendor_email": None,
            "invoice_date": "2025-09-19", "due_date": "2025-10-03", "currency": "GBP",
            "line_items": [
                {"description": "sea lavender", "quantity": 7, "unit_price": 3.15, "amount": 22.05},
                {"description": "willow stakes", "quantity": 30, "unit_price": 0.85, "amount": 25.50},
                {"description": "delivery", "quantity": 1, "unit_price": 9.00, "amount": 9.00},
            ],
            "subtotal": 56.55, "tax": 0, "total": 56.55, "po_number": None, "status": "pending",
        },
    ),
)


def sample_documents(spark: SparkSession) -> DataFrame:
    """name, raw_text, record (JSON text)."""
    rows = [(name, text, json.dumps(record)) for name, text, record in SAMPLES]
    return spark.createDataFrame(rows, "name string, raw_text string, record string")
