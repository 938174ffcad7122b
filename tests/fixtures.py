"""Small exports with known results, as literals."""

SUMMARY = """Invoice Number;Merchant;Issue Date;Due On;Sub Total;Sales Tax;Grand Total;Currency;Payment Status;Purchase Order
QZ-17;Tidewater Kelp Farm;25.02.2025;27.03.2025;310,40;0,00;"€ 310,40";EUR;Open;PX 7714
QZ-18;Moss & Fern Florists;02.03.2025;;95,00;19,95;114,95;EUR;Complete;
QZ-19;Tidewater Kelp Farm;11.01.2025;10.02.2025;1.200,00;252,00;1.452,00;SEK;Late;PX 7715
"""

STALL_LINES = """Ref,Seller,Issued,Product,Units,Rate,Extended
ST-1,Puffin Bakery,2025-05-04,Rye loaf,12,3.25,39.00
st 1,Puffin Bakery,2025-05-04,Seed roll,40,0.55,22.00
ST-2,Wren Dairy,2025-05-06,Goat curd,6,4.10,24.60
ST-2,Wren Dairy,2025-05-06,Butter,9,2.80,25.20
ST-2,Wren Dairy,2025-05-06,Whey,1,1.75,1.75
"""

BRIDGE_BILLS = """{"made": "2025-06-30", "bills": [
 {"reference": "BR/9", "company": {"title": "Heron Bridgeworks", "email": "toll@heron.example"}, "billing_date": "2025-06-01",
  "pay_by": "2025-07-01", "ccy": "NOK", "items": [{"item": "Plank deck", "qty": 14, "rate": 52.5}, {"item": "Bolt set", "qty": 3, "rate": 18}],
  "net": 789, "vat": 197.25, "total_due": 986.25, "status": "paid in cash"},
 {"reference": "BR/10", "company": {"title": "Gannet Nets", "email": null}, "billing_date": "2025-06-04",
  "pay_by": null, "ccy": "NOK", "items": [{"item": "Herring net", "qty": 2, "rate": 410.0}],
  "net": 820, "vat": 0, "total_due": 820, "status": "open"}]}"""

TOLLS = """Biller,Reference,Bill Date,Balance Due
Curlew Causeway,CC-3,2025-08-09,64
Curlew Causeway,CC-4,2025-08-10,71.5
"""

FILES = {
    "kelp.csv": SUMMARY,
    "stall.csv": STALL_LINES,
    "bridge.json": BRIDGE_BILLS,
    "tolls.csv": TOLLS,
    "ops export.csv": "Ref,Vendor,Date,Total\n,Acme,2026-02-01,50.00\n",
    "desc.csv": "Invoice,Vendor,Date,Description,Subtotal,Total\nD-1,Acme,2026-02-01,Annual licence renewal,500.00,500.00\n",
    "bad-dates.csv": "Invoice,Vendor,Date,Total\nX-1,Acme,sometime,10.00\n",
    "orphans.csv": (
        "Invoice,Vendor,Item,Qty,Unit Price,Line Total\nG-1,Acme,Setup,1,100.00,100.00\n"
        "G-1,Acme,Support,2,50.00,100.00\n,Acme,Orphan line,1,10.00,10.00\n"
    ),
    "extra.csv": "Invoice,Vendor,Date,Total,Internal Notes,Cost Centre\nA-1,Acme,2026-02-01,10.00,ignore me,CC-9\n",
    "bare_total.csv": "Invoice,Vendor,Date,Amount\nA-1,Acme,2026-01-05,10.00\n",
    "bare_line.csv": "Invoice,Description,Amount,Grand Total\nA-1,Setup,10.00,30.00\nA-1,Support,20.00,30.00\n",
    "pounds.csv": "Invoice,Vendor,Date,Amount Due\nA-1,Acme,2026-01-05,£40.00\n",
    "unclear_dates.csv": "Invoice,Date\nA-1,03/08/2026\nA-2,04/09/2026\n",
    "month_first.csv": "Invoice,Date\nA-1,08/28/2026\n",
}
