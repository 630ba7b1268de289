"""Names, thresholds and texts that results must carry as they are."""

# Floor layout: production line -> machines in flow order.
FLOOR_LAYOUT = {
    "Transmission Line": [
        "Source_Sorter_01_01", "Robotic_Arm_01_01", "Injection_Molder_01_01",
        "Valve_01_01", "Injection_Molder_01_02", "Robotic_Arm_01_02",
        "Painter_01_02", "Robotic_Arm_01_03", "Sorter_01_01",
    ],
    "Engine Line": [
        "Injection_Molder_02_01", "Valve_02_01", "Injection_Molder_02_02",
        "Robotic_Arm_02_01", "Painter_02_01", "Robotic_Arm_02_02", "Sorter_02_01",
    ],
    "Exterior Line": [
        "Sorter_03_01", "Robotic_Arm_03_01", "Injection_Molder_03_01",
        "Valve_03_01", "Injection_Molder_03_02", "Robotic_Arm_03_02",
        "Painter_03_01", "Robotic_Arm_03_03", "Injection_Molder_03_03",
    ],
    "Interior Line": [
        "Injection_Molder_04_01", "Valve_04_01", "Robotic_Arm_04_01",
        "Painter_04_01", "Sorter_04_01",
    ],
}

# Text found in a machine name -> machine type, first match wins.
TYPE_BY_NAME_PART = [
    ("sorter", "sorter"),
    ("robotic", "robotic_arm"),
    ("molder", "injection_molder"),
    ("painter", "painter"),
    ("valve", "valve"),
]
DEFAULT_TYPE = "sorter"

ICON_BY_TYPE = {
    "injection_molder": "injection_molder.png",
    "robotic_arm": "robotic_arm.png",
    "sorter": "sorter.png",
    "painter": "painter.png",
    "valve": "valve_icon.png",
}

# LIKE pattern on the machine name -> reporting line, first match wins.
LINE_BY_PATTERN = [
    ("%_01_%", "Line_1"),
    ("%_02_%", "Line_2"),
    ("%_03_%", "Line_3"),
]
UNKNOWN_LINE = "Unknown"

# Display status -> (exact texts, contained texts), first match wins.
STATUS_WORDS = [
    ("operational", ["operational"], ["running"]),
    ("warning", ["warning"], ["caution", "warn"]),
    ("down", ["down"], ["error", "fault", "failed"]),
]
UNKNOWN_STATUS = "unknown"

PRIORITIES = ["low", "medium", "high", "critical"]
PRIORITY_REPORT_ORDER = ["critical", "high", "medium", "low"]
DEFAULT_PRIORITY = "medium"
ORDER_STATUSES = ["open", "in_progress", "completed", "cancelled"]
DEFAULT_ORDER_STATUS = "open"
UNFINISHED = ["open", "in_progress"]
UNASSIGNED = "Unassigned"

# Upper age in hours (exclusive) -> label; anything older takes the last label.
AGE_BUCKETS = [
    (24, "Less than 1 day"),
    (72, "1-3 days"),
    (168, "3-7 days"),
    (720, "1-4 weeks"),
]
OLDEST_BUCKET = "Over 1 month"

# Assumed performance and quality, in ten-thousandths: 0.85 * 0.95.
OEE_FACTOR_PER_10000 = 8075

# Alert names of the exception report and their ages in hours.
ALERT_CRITICAL = "Critical Open Work Orders"
ALERT_OVERDUE = "Overdue High Priority Orders"
ALERT_UNASSIGNED = "Unassigned Orders Over 24h"
ALERT_DOWN = "Machines Down Over 4h"
OVERDUE_HOURS = 48
UNASSIGNED_HOURS = 24
DOWN_HOURS = 4

# (category, name, target, value type) of the executive KPIs.
KPI_MACHINES = ("Manufacturing Overview", "Total Machines", 25.0, "count")
KPI_UPTIME = ("Manufacturing Overview", "Current Uptime %", 95.0, "percentage")
KPI_OPEN = ("Work Orders", "Open Orders", 10.0, "count")
KPI_CRITICAL = ("Work Orders", "Critical Orders", 0.0, "count")
KPI_RESOLUTION = ("Performance", "Avg Resolution Time (hours)", 24.0, "hours")

# Change envelope.
FEED_TABLE = "machine_feed_stream"

# Column widths of the stored tables.
MAX_LENGTHS = {
    "work_orders": {"id": 50, "machine_id": 100, "priority": 20, "reporter_name": 100,
                    "assignee": 100, "status": 20},
    "employees": {"first_name": 100, "last_name": 100, "email": 255, "department": 100},
}
