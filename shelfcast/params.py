"""Business rules: every threshold and every label, with its default value.

`DEFAULT` holds the rules of the original shop. `BINDING` holds the same rules scaled to
the driver tables (see FIXTURES.md section 4); queries and tests pass it explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

DELETED_MARK = "{DEL}"

# --- fixed values: labels that appear in result columns --------------------------------
RETAIL, BULK, ORGANIZATION, INTERNAL = "retail", "bulk", "organization", "internal"
WHOLESALE = (BULK, ORGANIZATION)
CHANNEL_RETAIL = "Bán lẻ"
CHANNEL_WHOLESALE = "Đơn lớn / tổ chức"
CHANNEL_INTERNAL = "Nội bộ"
UNKNOWN_BRAND = "Không rõ"
OPENING_PROMO = "Khuyến mại khai trương"
OPENING_PROMO_MISSPELT = "Khuyến mại khai chương"
QUADRANT_STAR, QUADRANT_THIN = "Ngôi sao", "Lời mỏng"
QUADRANT_POTENTIAL, QUADRANT_REVIEW = "Tiềm năng", "Cần xem xét"
QUADRANT_LOSS = "Thua lỗ"
BEFORE_HOLIDAY, AFTER_HOLIDAY, NORMAL_DAYS = "Trước Tết", "Sau Tết", "Nền"
WHOLE_STORE = "Toàn cửa hàng"
FREQUENT, OCCASIONAL, ONCE = "thuong_xuyen", "thinh_thoang", "mot_lan"
STOCKOUT_OPEN = "Không bán tới cuối kỳ: hết hàng hoặc đã ngừng bán"
STOCKOUT_CLOSED = "Nghi ngờ hết hàng"
COST_ACTUAL, COST_SKU, COST_CATEGORY = "actual", "sku_median", "category_ratio"
COST_UNFILLED = "không điền được"
CONF_HIGH, CONF_MID, CONF_LOW, CONF_NONE = "Cao", "Trung bình", "Thấp", "Chưa đủ dữ liệu"
SERVICE_STAR, SERVICE_PERISHABLE, SERVICE_DURABLE = "Ngôi sao", "Dễ hư hỏng", "Bảo quản lâu"
SCOPE_ALL, SCOPE_SELECTION = "Tổng thể", "Giai đoạn chọn mô hình"
LEVEL_L3, LEVEL_L2, LEVEL_L1 = "Nhóm hàng cấp 3", "Nhóm hàng cấp 2", "Ngành hàng cấp 1"
MODE_SINGLE, MODE_CARRY = "Một kỳ (không chuyển tồn)", "Nhiều kỳ (có chuyển tồn)"
SNAPSHOT_LIVE, SNAPSHOT_REPLAY = "Dự báo thật", "Mô phỏng lại"
FALLBACK_MODEL = "TB 8 tuần (chưa đủ dữ liệu)"

# --- fixed values: phrases searched in lower-cased invoice notes -----------------------
INTERNAL_NOTES = (
    "nội bộ", "hàng mẫu", "lấy mẫu", "xuất mẫu", "làm hàng mẫu", "nhà cung cấp",
    "nhà phân phối", "chuyển về kho", "livestream", "đi quay",
)
ORGANIZATION_NOTES = (
    "cty", "công ty", "công đoàn", "ub xã", "huyndai", "hyundai", "vinfast", "hải thịnh",
    "dolee", "set quà", "dính kế",
)
CREDIT_NOTES = ("nợ", "chưa tt")

# --- fixed values: category paths that are wrong in the source, and their repair -------
CATEGORY_FIXES = {
    "Gạo": "Gạo, bột và thực phẩm khô>>Gạo>>Gạo",
    "Dưỡng Thể": "Chăm sóc cá nhân>>Chăm sóc cơ thể>>Dưỡng thể",
    "Dung Dịch Vệ Sinh": "Chăm sóc cá nhân>>Chăm sóc cơ thể>>Dung dịch vệ sinh",
    "Bánh{DEL}": "Bánh, kẹo, snack>>Bánh>>Bánh Tổng Hợp",
    "chưa khai báo": "Chưa phân loại>>Chưa phân loại>>Chưa phân loại",
    "Chăm sóc cá nhân>>Gây Hại Sức Khỏe>>Thuốc Lá": "Thuốc lá>>Thuốc lá>>Thuốc lá",
    "Sữa, sản phẩm từ sữa>>Sữa nước các loại>>Sữa tươi 1":
        "Sữa, sản phẩm từ sữa>>Sữa nước các loại>>Sữa tươi",
    "Đồ uống>>Nước ngọt": "Đồ uống>>Nước ngọt>>Nước giải khát",
}

# --- fixed values: shelf life in weeks of short-lived level-3 categories ---------------
SHELF_LIFE_WEEKS = {
    "Rau lá khác": 1, "Nấm tươi": 1, "Rau, củ": 1, "Sản phẩm cân": 1, "Củ quả": 1,
    "Trái cây": 1, "Trái cây trong nước": 1, "Thực phẩm sơ chế, tẩm ướp": 1,
    "Sơ chế, tẩm ướp": 1, "Thực phẩm chế biến sẵn": 1, "Trứng": 3, "Sữa chua": 4,
    "Sữa chua uống": 4, "Phô mai": 4,
}

# --- fixed values: order quantile by service class -------------------------------------
SERVICE_TAU = {SERVICE_STAR: 0.80, SERVICE_PERISHABLE: 0.55, SERVICE_DURABLE: 0.70}
TAUS = (0.1, 0.5, 0.55, 0.7, 0.8, 0.9)

# --- fixed values: columns that must never leave the cleaned layer ----------------------
SENSITIVE_COLUMNS = frozenset({"seller", "note", "seller_code", "invoice_id"})


@dataclass(frozen=True)
class Rules:
    # staging
    category_fixes: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_FIXES))
    suspect_cost_ratio: float = 3.0
    bulk_invoice_units: float = 100.0
    bulk_invoice_value: float = 3_000_000.0
    bulk_line_units: float = 48.0
    bulk_line_ratio: float = 10.0
    # Lines of one clean sku in a time slice of its history.
    hot_key_rows: int = 5_000_000
    # marts
    discount_cut: float = 0.95
    abc_cuts: tuple[float, float] = (0.80, 0.95)
    large_retail_invoice: float = 500_000.0
    reserve_test_months: int = 3
    holidays: tuple[date, ...] = (date(2026, 2, 17), date(2027, 2, 6))
    holiday_before: int = 14
    holiday_after: int = 13
    # basket rules
    basket_level: str = "cat_l3"
    min_support: float = 0.01
    min_lift: float = 1.2
    # stock-out suspicion
    stockout_entity: str = "sku"
    min_sell_ratio: float = 0.15
    min_gap: int = 5
    max_gap_probability: float = 0.01
    # series and evaluation
    series_level: str = "cat_l3"
    impute_weeks: int = 6
    min_sale_days: int = 20
    adi_cut: float = 1.32
    cv2_cut: float = 0.49
    horizon: int = 7
    n_windows: int = 12
    n_selection: int = 4
    long_horizon: int = 28
    long_windows: int = 9
    max_abs_bias: float = 0.10
    # ordering
    shelf_life: dict[str, int] = field(default_factory=lambda: dict(SHELF_LIFE_WEEKS))
    perishable_max_weeks: int = 4
    holding_rate_week: float = 0.01 * 12 / 52
    min_forecast_for_ratio: float = 0.5
    top_skus: int = 8
    share_days: int = 56
    # monitoring
    drift_factor: float = 1.3
    ts_limit: float = 4.0

    def scaled(self, **changes) -> "Rules":
        return replace(self, **changes)


DEFAULT = Rules()

# Level-2 names of the driver binding look like SMALL-3; their last digit sets a shelf life.
_BINDING_SHELF_LIFE = {0: 1, 1: 3, 2: 4}
_BINDING_TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")

BINDING = DEFAULT.scaled(
    category_fixes={**CATEGORY_FIXES, "SMALL{DEL}": "SMALL>>SMALL-4>>SMALL-4-5"},
    bulk_invoice_units=200.0,
    bulk_invoice_value=190_000.0,
    bulk_line_ratio=2.0,
    large_retail_invoice=100_000.0,
    holidays=tuple(date(y, 2, 10) for y in range(1996, 2002)),
    basket_level="cat_l2",
    min_lift=1.0,
    stockout_entity="cat_l2",
    series_level="cat_l2",
    shelf_life={f"{t}-{d}": w for t in _BINDING_TYPES for d, w in _BINDING_SHELF_LIFE.items()},
)
