from __future__ import annotations

import csv
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketlens.plans.analyses import Retail  # noqa: E402
from marketlens.session import local_session  # noqa: E402
from marketlens.sources.tables import SCHEMAS, load_tables  # noqa: E402

# A small marketplace. o1 has two items and two payments (four fact rows), o3
# no items, o4 no payment, o6 an item of unknown category next to a known one.
MARKET = {
    "orders": [
        # id, customer, purchased, delivered, estimated
        ("o1", "c1", "2018-01-01 23:00:00", "2018-01-05 22:00:00", "2018-01-10 00:00:00"),
        ("o2", "c2", "2018-01-02 01:00:00", "2018-01-20 00:00:00", "2018-01-10 00:00:00"),
        ("o3", "c3", "2018-03-10 12:00:00", "", "2018-03-20 00:00:00"),
        ("o4", "c4", "2018-03-11 12:00:00", "2018-03-11 10:00:00", "2018-03-20 00:00:00"),
        ("o5", "c5", "2018-09-30 08:30:00", "2018-10-02 09:00:00", "2018-10-02 00:00:00"),
        ("o6", "c6", "2018-09-30 09:00:00", "2018-10-05 09:00:00", "2018-10-20 00:00:00"),
        ("o7", "c7", "not a date", "2018-10-05 09:00:00", "2018-10-20 00:00:00"),
    ],
    "customers": [
        # id, unique, zip, city, state
        ("c1", "u1", "1001", "sao paulo", "SP"),
        ("c2", "u1", "1001", "sao paulo", "SP"),
        ("c3", "u2", "2002", "rio", "RJ"),
        ("c4", "u3", "2002", "rio", "RJ"),
        ("c5", "u2", "2002", "rio", "RJ"),
        ("c6", "u4", "3003", "", "MG"),
        ("c7", "u5", "3003", "bh", "MG"),
    ],
    "order_items": [
        # order, product, seller, price, freight
        ("o1", "p1", "s1", "10.00", "1.00"),
        ("o1", "p2", "s2", "20.00", "2.50"),
        ("o2", "p1", "s1", "10.00", "5.00"),
        ("o4", "p2", "s2", "20.00", "2.00"),
        ("o5", "p1", "s1", "10.00", "0.00"),
        ("o5", "p1", "s1", "10.00", "0.00"),
        ("o5", "p3", "s1", "30.00", "-1.00"),
        ("o5", "p3", "s1", "0.00", "1.00"),
        ("o6", "p4", "s2", "40.00", "4.00"),
        ("o6", "p2", "s2", "20.00", "4.00"),
        ("o7", "p3", "s2", "30.00", "3.00"),
    ],
    "order_payments": [
        ("o1", "25.00"),
        ("o1", "8.50"),
        ("o2", "15.00"),
        ("o3", "7.00"),
        ("o5", "20.00"),
        ("o6", "68.00"),
        ("o7", "33.00"),
    ],
    "order_reviews": [
        # review, order, score, created
        ("r1", "o1", "5", "2018-01-06 00:00:00"),
        ("r2", "o2", "1", "2018-01-21 00:00:00"),
        ("r3", "o4", "3", "2018-03-12 00:00:00"),
        ("r4", "o5", "2", "bad"),
        ("r5", "o5", "4.0", "2018-10-03 00:00:00"),
        ("r6", "o6", "", "2018-10-06 00:00:00"),
        ("", "o6", "4", "2018-10-06 00:00:00"),
    ],
    "products": [
        # id, category, weight, length, height, width
        ("p1", "cama", "100", "10", "", "5"),
        ("p2", "beleza", "300", "", "4", "5"),
        ("p3", "casa", "", "20", "2", "5"),
        ("p4", "sem nome", "9000", "90", "90", "90"),
    ],
    "category_translation": [("cama", "Bed "), ("beleza", "beauty"), ("casa", "home")],
    "geolocation": [
        ("1001", "-23.0", "-46.0", "sao paulo", "SP"),
        ("1001", "-24.0", "-47.0", "sp", "SP"),
        ("2002", "-22.0", "-43.0", "rio", "RJ"),
    ],
    "sellers": [("s1", "1001", "sao paulo", "SP"), ("s2", "2002", "rio", "RJ")],
}

COLUMNS = {
    "orders": ["order_id", "customer_id", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"],
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
    "order_items": ["order_id", "product_id", "seller_id", "price", "freight_value"],
    "order_payments": ["order_id", "payment_value"],
    "order_reviews": ["review_id", "order_id", "review_score", "review_creation_date"],
    "products": ["product_id", "product_category_name", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"],
    "category_translation": ["product_category_name", "product_category_name_english"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city", "geolocation_state"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
}


def write_market(folder: Path) -> None:
    """The small marketplace as CSV files with all columns of the schemas."""
    for name, rows in MARKET.items():
        fields = SCHEMAS[name].names
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.DictWriter(f, fields)
            out.writeheader()
            for row in rows:
                out.writerow({**dict.fromkeys(fields, ""), **dict(zip(COLUMNS[name], row))})


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", memory="8g")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return session


@pytest.fixture(scope="session")
def market_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("market")
    write_market(folder)
    return folder


@pytest.fixture(scope="session")
def raw_market(spark, market_folder):
    return load_tables(spark, str(market_folder))


@pytest.fixture(scope="session")
def market(raw_market):
    return Retail(raw_market)


@pytest.fixture(scope="session")
def star(spark):
    return Retail.from_star(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of rows, split over a few partitions."""

    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
