"""Contracts of the seventeen domain tables: column types, keys and integrity rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from depotwise.policy import AUDIT_OPERATIONS, PLATFORMS, SHIPMENT_LIFECYCLE

MONEY = T.DecimalType(10, 2)
LINE_AMOUNT = T.DecimalType(21, 2)
TOTAL_AMOUNT = T.DecimalType(31, 2)

_TYPES = {
    "id": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "money": MONEY,
    "ts": T.TimestampNTZType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class Table:
    """One table contract. ``columns`` maps a name to ``type`` or ``type?`` (nullable)."""

    columns: dict[str, str]
    key: str
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: dict[str, str] = field(default_factory=dict)
    positive: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    different: tuple[tuple[str, str], ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?"))
                for name, kind in self.columns.items()
            ]
        )

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(name for name, kind in self.columns.items() if not kind.endswith("?"))


TABLES: dict[str, Table] = {
    "supplier": Table(
        {"supplier_id": "id", "name": "text", "phone": "text?", "address": "text?"},
        key="supplier_id",
        lengths={"name": 150, "phone": 20},
    ),
    "product": Table(
        {
            "product_id": "id",
            "supplier_id": "id",
            "name": "text",
            "category": "text?",
            "price": "money",
        },
        key="product_id",
        foreign={"supplier_id": "supplier"},
        non_negative=("price",),
        lengths={"name": 150, "category": 80},
    ),
    "warehouse": Table(
        {"warehouse_id": "id", "name": "text", "location": "text?", "capacity_units": "int"},
        key="warehouse_id",
        unique=(("name",),),
        positive=("capacity_units",),
        lengths={"name": 100, "location": 150},
    ),
    "inventory": Table(
        {"inventory_id": "id", "warehouse_id": "id", "product_id": "id", "quantity": "int"},
        key="inventory_id",
        unique=(("warehouse_id", "product_id"),),
        foreign={"warehouse_id": "warehouse", "product_id": "product"},
        non_negative=("quantity",),
    ),
    "stock_transfer": Table(
        {
            "transfer_id": "id",
            "from_warehouse_id": "id",
            "to_warehouse_id": "id",
            "product_id": "id",
            "quantity": "int",
            "transfer_date": "ts",
            "origin_date": "ts",
        },
        key="transfer_id",
        foreign={
            "from_warehouse_id": "warehouse",
            "to_warehouse_id": "warehouse",
            "product_id": "product",
        },
        positive=("quantity",),
        different=(("from_warehouse_id", "to_warehouse_id"),),
    ),
    "customer": Table(
        {"customer_id": "id", "name": "text", "contact": "text?"},
        key="customer_id",
        lengths={"name": 150, "contact": 100},
    ),
    "order": Table(
        {"order_id": "id", "customer_id": "id", "order_date": "ts", "status": "text"},
        key="order_id",
        foreign={"customer_id": "customer"},
        lengths={"status": 30},
    ),
    "order_item": Table(
        {
            "order_item_id": "id",
            "order_id": "id",
            "product_id": "id",
            "quantity": "int",
            "unit_price": "money",
        },
        key="order_item_id",
        foreign={"order_id": "order", "product_id": "product"},
        positive=("quantity",),
        non_negative=("unit_price",),
    ),
    "campaign": Table(
        {
            "campaign_id": "id",
            "product_id": "id",
            "campaign_name": "text",
            "start_date": "date?",
            "end_date": "date?",
        },
        key="campaign_id",
        foreign={"product_id": "product"},
        lengths={"campaign_name": 150},
    ),
    "tracking_link": Table(
        {
            "link_id": "id",
            "campaign_id": "id",
            "platform": "text",
            "short_code": "text",
            "destination_url": "text?",
        },
        key="link_id",
        unique=(("short_code",),),
        foreign={"campaign_id": "campaign"},
        domains={"platform": PLATFORMS},
        lengths={"platform": 30, "short_code": 20},
    ),
    "order_attribution": Table(
        {"attribution_id": "id", "order_id": "id", "link_id": "id", "attributed_time": "ts"},
        key="attribution_id",
        unique=(("order_id",),),
        foreign={"order_id": "order", "link_id": "tracking_link"},
    ),
    "click": Table(
        {
            "click_id": "id",
            "link_id": "id",
            "click_time": "ts",
            "country": "text?",
            "device": "text?",
            "customer_id": "id?",
        },
        key="click_id",
        foreign={"link_id": "tracking_link", "customer_id": "customer"},
    ),
    "shipment": Table(
        {"shipment_id": "id", "order_id": "id", "tracking_code": "text?", "shipment_date": "ts"},
        key="shipment_id",
        unique=(("tracking_code",),),
        foreign={"order_id": "order"},
        lengths={"tracking_code": 20},
    ),
    "shipment_status": Table(
        {
            "status_id": "id",
            "shipment_id": "id",
            "location": "text?",
            "status": "text",
            "updated_time": "ts",
        },
        key="status_id",
        foreign={"shipment_id": "shipment"},
        domains={"status": SHIPMENT_LIFECYCLE},
        lengths={"location": 150, "status": 30},
    ),
    "purchase": Table(
        {"purchase_id": "id", "supplier_id": "id", "warehouse_id": "id", "purchase_date": "ts"},
        key="purchase_id",
        foreign={"supplier_id": "supplier", "warehouse_id": "warehouse"},
    ),
    "purchase_item": Table(
        {
            "purchase_item_id": "id",
            "purchase_id": "id",
            "product_id": "id",
            "quantity": "int",
            "unit_cost": "money",
        },
        key="purchase_item_id",
        foreign={"purchase_id": "purchase", "product_id": "product"},
        positive=("quantity",),
        non_negative=("unit_cost",),
    ),
    "audit_log": Table(
        {
            "log_id": "id",
            "table_name": "text",
            "operation": "text",
            "record_id": "id?",
            "log_time": "ts",
        },
        key="log_id",
        domains={"operation": AUDIT_OPERATIONS},
        lengths={"table_name": 50, "operation": 10},
    ),
}
