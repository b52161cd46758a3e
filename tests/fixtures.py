"""Base sales rows in each file format."""

from posrecon.config import FormatConfig, LayoutField

# Sales rows of both sides, the layouts of the files, and the sums that all formats must give.
ROWS = [
    ("S001", "100001", "Widget A", "10", "99.90"),
    ("S001", "100002", "Gadget B", "5", "49.95"),
    ("S002", "100001", "Widget A", "8", "79.92"),
    ("S003", "100003", "Doohickey", "20", "199.80"),
]
TEST_ROWS = [
    ("S001", "100001", "Widget A", "12", "119.88"),
    ("S001", "100002", "Gadget B", "5", "49.95"),
    ("S002", "100001", "Widget A", "8", "79.92"),
    ("S003", "100003", "Doohickey", "20", "199.80"),
    ("S004", "100004", "NewItem", "7", "69.93"),
]
NAMES = ["Store", "UPC", "Description", "Units", "Price"]
ROLES = dict(
    store_col="Store", upc_col="UPC", desc_col="Description", units_col="Units", price_col="Price"
)

FIXED_LAYOUT = [
    LayoutField("Store", 0, 6, "text"),
    LayoutField("UPC", 6, 16, "numeric"),
    LayoutField("Description", 16, 36, "text"),
    LayoutField("Units", 36, 41, "numeric"),
    LayoutField("Price", 41, 49, "numeric"),
]
HEADER_LAYOUT = [LayoutField("Store", 5, 9), LayoutField("Date", 12, 22)]
DETAIL_LAYOUT = [
    LayoutField("UPC", 0, 12),
    LayoutField("Description", 12, 33),
    LayoutField("Units", 33, 35, "numeric"),
    LayoutField("Price", 35, 43, "numeric"),
]
TRAILER_LAYOUT = [
    LayoutField("TotalUnits", 3, 9, "numeric"),
    LayoutField("TotalPrice", 9, 18, "numeric"),
]

GOLDEN = {
    "store": [("S001", 15.0, 149.85), ("S002", 8.0, 79.92), ("S003", 20.0, 199.8)],
    "item": [
        ("100001", "Widget A", 18.0, 179.82),
        ("100002", "Gadget B", 5.0, 49.95),
        ("100003", "Doohickey", 20.0, 199.8),
    ],
    "upc": [("100001", 18.0, 179.82), ("100002", 5.0, 49.95), ("100003", 20.0, 199.8)],
}


def delimited_text(rows, sep=","):
    return "\n".join([sep.join(NAMES)] + [sep.join(r) for r in rows]) + "\n"


def placed(layout, values, prefix=""):
    """A line with each value at its field's place, numbers to the right."""
    line = prefix
    for f, v in zip(layout, values):
        line = line.ljust(f.start) + (v.rjust(f.length) if f.type == "numeric" else v.ljust(f.length))
    return line


def fixed_text(rows):
    return "".join(placed(FIXED_LAYOUT, r) + "\n" for r in rows)


def records_text(rows):
    return "".join(f"H|{r[0]}|2024-01-15\nD|{'|'.join(r)}\n" for r in rows)


def hdr_text(rows):
    out, by_store = [], {}
    for r in rows:
        by_store.setdefault(r[0], []).append(r)
    for store, lines in by_store.items():
        out.append(placed(HEADER_LAYOUT, (store, "2024-01-15"), "HDR01"))
        out += [placed(DETAIL_LAYOUT, r[1:]) + " " * 5 for r in lines]
        units = sum(int(x[3]) for x in lines)
        price = sum(float(x[4]) for x in lines)
        out.append(placed(TRAILER_LAYOUT, (str(units), f"{price:.2f}"), "TRL"))
    return "\n".join(out) + "\n"


FORMATS = {
    "delimited": (delimited_text, FormatConfig(file_type="delimited", delimiter=",", **ROLES)),
    "fixed": (fixed_text, FormatConfig(file_type="fixed", layout=FIXED_LAYOUT, **ROLES)),
    "multiline": (
        records_text,
        FormatConfig(file_type="multiline", ml_record_types=["D"], schema=NAMES, **ROLES),
    ),
    "hdr_fixed": (
        hdr_text,
        FormatConfig(
            file_type="multiline", header_prefix="HDR", header_layout=HEADER_LAYOUT,
            layout=DETAIL_LAYOUT, trailer_prefix="TRL", trailer_layout=TRAILER_LAYOUT,
            schema=["Store", "date", "UPC", "Description", "Units", "Price",
                    "total_units", "total_price"],
            **ROLES,
        ),
    ),
}


def rounded(df, digits=4):
    return [
        tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()
    ]
