"""Ledger schemas, insert defaults and the field dictionaries.

Money is decimal so sums are exact; results are cast to double at output.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
CONTRACT = T.DecimalType(15, 2)
DAYS = T.DecimalType(6, 1)
PRICE = T.DecimalType(10, 2)
PAID = T.DecimalType(18, 4)


def _s(fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _s([("id", T.StringType()), ("email", T.StringType()), ("plan", T.StringType()),
            ("plan_limit", T.IntegerType()), ("usage_count", T.IntegerType()),
            ("created_at", T.TimestampType())])

PROJECTS = _s([("id", T.StringType()), ("user_id", T.StringType()), ("name", T.StringType()),
               ("client_name", T.StringType()), ("location", T.StringType()),
               ("contract_value", CONTRACT), ("start_date", T.DateType()),
               ("end_date", T.DateType()), ("status", T.StringType()),
               ("created_at", T.TimestampType())])

LABOR_COSTS = _s([("id", T.StringType()), ("project_id", T.StringType()),
                  ("user_id", T.StringType()), ("worker_name", T.StringType()),
                  ("worker_type", T.StringType()), ("work_days", DAYS),
                  ("daily_rate", PRICE), ("total_amount", MONEY), ("paid_amount", PAID),
                  ("work_date", T.DateType()), ("note", T.StringType()),
                  ("source", T.StringType()), ("created_at", T.TimestampType())])

MATERIAL_COSTS = _s([("id", T.StringType()), ("project_id", T.StringType()),
                     ("user_id", T.StringType()), ("item_name", T.StringType()),
                     ("quantity", PRICE), ("unit", T.StringType()), ("unit_price", PRICE),
                     ("total_amount", MONEY), ("supplier", T.StringType()),
                     ("purchase_date", T.DateType()), ("note", T.StringType()),
                     ("source", T.StringType()), ("created_at", T.TimestampType())])

PAYMENT_MILESTONES = _s([("id", T.StringType()), ("project_id", T.StringType()),
                         ("user_id", T.StringType()), ("milestone_name", T.StringType()),
                         ("amount", MONEY), ("due_date", T.DateType()),
                         ("received_date", T.DateType()), ("status", T.StringType()),
                         ("note", T.StringType()), ("source", T.StringType()),
                         ("created_at", T.TimestampType())])

LEDGERS = {
    "users": USERS,
    "projects": PROJECTS,
    "labor_costs": LABOR_COSTS,
    "material_costs": MATERIAL_COSTS,
    "payment_milestones": PAYMENT_MILESTONES,
}

# Column defaults applied on insert (fixed values of the store).
DEFAULTS = {
    "users": {"plan": "starter", "plan_limit": 100, "usage_count": 0},
    "projects": {"status": "active"},
    "labor_costs": {"paid_amount": 0, "source": "manual"},
    "material_costs": {"source": "manual"},
    "payment_milestones": {"status": "pending", "source": "manual"},
}

# Import table type -> ledger table (any other type is used as the table name).
TABLE_OF_TYPE = {"labor": "labor_costs", "material": "material_costs",
                 "milestone": "payment_milestones"}

# Standard target fields and their header synonyms, per table type,
# in dictionary order (order breaks scoring ties).
LABOR_TARGETS = {
    "worker_name": ["ชื่อช่าง", "ชื่อ", "ช่าง", "แรงงาน", "name", "worker"],
    "worker_type": ["ประเภท", "type", "ตำแหน่ง", "สาขา"],
    "work_days": ["วันทำงาน", "จำนวนวัน", "วัน", "days", "day"],
    "daily_rate": ["ค่าแรง/วัน", "ค่าแรงต่อวัน", "rate", "daily"],
    "total_amount": ["ยอดรวม", "รวม", "total", "amount", "เงิน"],
    "paid_amount": ["จ่ายแล้ว", "paid", "ชำระ"],
    "work_date": ["วันที่", "date", "ว/ด/ป", "วันที่ทำงาน"],
    "note": ["หมายเหตุ", "note", "remark"],
}
MATERIAL_TARGETS = {
    "item_name": ["รายการ", "วัสดุ", "สินค้า", "item", "name", "ชื่อวัสดุ"],
    "quantity": ["จำนวน", "qty", "quantity", "ปริมาณ"],
    "unit": ["หน่วย", "unit"],
    "unit_price": ["ราคา/หน่วย", "unit_price", "ราคาต่อหน่วย", "price"],
    "total_amount": ["ยอดรวม", "รวม", "total", "amount"],
    "supplier": ["ร้าน", "supplier", "ผู้ขาย", "แหล่งซื้อ"],
    "purchase_date": ["วันที่", "date", "ว/ด/ป", "วันที่ซื้อ"],
    "note": ["หมายเหตุ", "note"],
}
MILESTONE_TARGETS = {
    "milestone_name": ["งวด", "milestone", "ชื่องวด", "รายการ"],
    "amount": ["มูลค่า", "amount", "ยอดเงิน", "เงิน"],
    "due_date": ["กำหนด", "due", "วันครบกำหนด", "due_date"],
    "received_date": ["รับแล้ว", "received", "วันรับเงิน"],
    "status": ["สถานะ", "status"],
    "note": ["หมายเหตุ", "note"],
}
TARGETS = {"labor": LABOR_TARGETS, "material": MATERIAL_TARGETS,
           "milestone": MILESTONE_TARGETS}

NUMERIC_FIELDS = ["work_days", "daily_rate", "total_amount", "paid_amount",
                  "quantity", "unit_price", "amount"]
DATE_FIELDS = ["work_date", "purchase_date", "due_date", "received_date"]

# Every canonical field over the three table types, in a fixed order.
ALL_FIELDS = list(dict.fromkeys(f for t in TARGETS.values() for f in t))
