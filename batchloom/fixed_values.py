"""Names, constants and sample rows that results must equal."""

from decimal import Decimal

# Generated event batch. Category is picked by id mod 4, in this order.
CATEGORIES = ("electronics", "grocery", "household", "farm")
QUANTITY_CYCLE = 10
PRICE_BASE = 50
PRICE_STEP = 37
PRICE_CYCLE = 10000
PRICE_DIVISOR = Decimal("10.0")
DEFAULT_ROWS = 100_000
DEFAULT_PARTITIONS = 4

# Enrichment.
BULK_FROM = 6
BULK = "bulk"
STANDARD = "standard"
LARGE_LINE_TOTAL = 1000
ENRICHED_TYPES = {"line_total": "double", "quantity_band": "string"}

# The sample sales batch: product_id, category, quantity, unit_price.
SALES_ROWS = (
    (101, "electronics", 2, 2499.00),
    (102, "electronics", 1, 4999.00),
    (201, "grocery", 5, 120.00),
    (202, "grocery", 3, 250.00),
    (301, "household", 4, 450.00),
)

# Run status.
RUNNING = "Running"
PENDING = "Pending"
FAILED = "Failed"
SUCCEEDED = "Succeeded"
TERMINAL_PHASES = ("Succeeded", "Failed", "Error")
FAILED_POLLS_LIMIT = 3
SLOTS_PER_WORKER = 1
DRIVER_TAIL = 1
WORKER_TAIL = 80
