"""Word lists, patterns and defaults that decide results.

Everything here is data.  Operators take these values as arguments, so other vocabularies can be used.
"""

from __future__ import annotations

# --- fixed values: identifiers -------------------------------------------------------------------
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # RFC 4122 URL namespace
DOCUMENT_ID_PREFIX = "document:"

# --- fixed values: chunking ----------------------------------------------------------------------
CHUNK_SIZE = 512
REGION_MAX_TOKENS = 2500
GROUPING_MIN_TOKENS = 400
CONTEXT_WORDING = {"document": "Trích từ ", "under": "Thuộc: ", "table": "Dữ liệu dạng bảng."}
PROPOSED_CHUNK_TYPES = ("text", "list", "mixed")

# --- fixed values: document header ---------------------------------------------------------------
DOC_TYPE_RULES = (
    ("ke_hoach", r"(?U)KẾ\s+HOẠCH"),
    ("quyet_dinh", r"(?U)QUYẾT\s+ĐỊNH"),
    ("thong_tu", r"(?U)THÔNG\s+TƯ"),
)
DOC_TYPE_OTHER = "khac"
DATE_PATTERN = r"(?iuU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
NUMBER_PATTERN = r"(?iuU)Số\s*:\s*([0-9][0-9A-Za-zĐ/.\-]*)"
NUMBER_LABEL = "Số "
ISSUER_PREFIXES = (
    "ỦY BAN NHÂN DÂN",
    "BỘ GIÁO DỤC",
    "SỞ GIÁO DỤC",
    "PHÒNG GIÁO DỤC",
    "HỘI ĐỒNG",
    "CHÍNH PHỦ",
)

# --- fixed values: file titles -------------------------------------------------------------------
YEAR_PATTERN = r"(20\d{2})\s*[-–]?\s*(20\d{2})"
LOCALITY_PATTERN = r"(?iuU)(?:phường|xã|đặc\s+khu)\s+(.+?)(?=\s*,|\s+năm\b|\s*\d|\.pdf|$)"

# --- fixed values: localities known to the title and query parsers --------------------------------
LOCALITIES = (
    "An Khánh", "An Long", "An Nhơn", "An Nhơn Tây", "An Phú", "An Phú Đông", "An Đông", "Bà Rịa",
    "Bà Điểm", "Bàn Cờ", "Bàu Bàng", "Bàu Lâm", "Bình Chánh", "Bình Châu", "Bình Cơ", "Bình Dương",
    "Bình Giã", "Bình Hưng", "Bình Hưng Hòa", "Bình Khánh", "Bình Lợi", "Bình Lợi Trung",
    "Bình Phú", "Bình Qưới", "Bình Thạnh", "Bình Thới", "Bình Tiên", "Bình Trưng", "Bình Trị Đông",
    "Bình Tân", "Bình Tây", "Bình Đông", "Bảy Hiền", "Bắc Tân Uyên", "Bến Cát", "Bến Thành",
    "Chánh Hiệp", "Chánh Hưng", "Chánh Phú Hòa", "Châu Pha", "Châu Đức", "Chợ Lớn", "Chợ Quán",
    "Cát Lái", "Côn Đảo", "Cần Giờ", "Cầu Kiệu", "Cầu Ông Lãnh", "Củ Chi", "Diên Hồng", "Dĩ An",
    "Dầu Tiếng", "Gia Định", "Gò Vấp", "Hiệp Bình", "Hiệp Phước", "Hòa Bình", "Hòa Hiệp",
    "Hòa Hưng", "Hòa Hội", "Hòa Lợi", "Hóc Môn", "Hưng Long", "Hạnh Thông", "Hồ Tràm", "Hội Tây",
    "Khánh Hội", "Linh Xuân", "Long Hòa", "Long Hương", "Long Hải", "Long Nguyên", "Long Phước",
    "Long Sơn", "Long Trường", "Long Điền", "Lái Thiêu", "Minh Phụng", "Minh Thạnh", "Ngãi Giao",
    "Nhiêu Lộc", "Nhuận Đức", "Nhà Bè", "Phú An", "Phú Giáo", "Phú Hòa Đông", "Phú Lâm", "Phú Lợi",
    "Phú Mỹ", "Phú Nhuận", "Phú Thuận", "Phú Thạnh", "Phú Thọ", "Phú Định", "Phước Hòa",
    "Phước Hải", "Phước Long", "Phước Thành", "Phước Thắng", "Sài Gòn", "Tam Bình", "Tam Long",
    "Tam Thắng", "Thanh An", "Thuận An", "Thuận Giao", "Thái Mỹ", "Thông Tây Hội", "Thường Tân",
    "Thạch An", "Thạnh Mỹ Tây", "Thọ Hòa", "Thới An", "Thới Hòa", "Thủ Dầu Một", "Thủ Đức",
    "Trung Mỹ Tây", "Trừ Văn Thố", "Tân An Hội", "Tân Bình", "Tân Hiệp", "Tân Hòa", "Tân Hưng",
    "Tân Hải", "Tân Khánh", "Tân Mỹ", "Tân Nhựt", "Tân Phú", "Tân Phước", "Tân Sơn", "Tân Sơn Hòa",
    "Tân Sơn Nhì", "Tân Sơn Nhất", "Tân Thuận", "Tân Thành", "Tân Thới Hiệp", "Tân Tạo",
    "Tân Vĩnh Lộc", "Tân Đông Hiệp", "Tân Định", "Tây Nam", "Tây Thạnh", "Tăng Nhơn Phú",
    "Vĩnh Hội", "Vĩnh Lộc", "Vĩnh Tân", "Vũng Tàu", "Vườn Lài", "Xuyên Mộc", "Xuân Hòa",
    "Xóm Chiếu", "Đông Hòa", "Đông Hưng Thuận", "Đông Thạnh", "Đất Đỏ", "Đức Nhuận",
)

# --- fixed values: uploads -----------------------------------------------------------------------
UPLOAD_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
MAX_UPLOAD_MB = 25
MAX_ERROR_CHARS = 1000

# --- fixed values: search ------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
RRF_CONSTANT = 60
HYBRID_ALPHA = 0.6
CANDIDATES = 30
VECTOR_TOP_K = 3
RERANK_TOP_N = 6
MERGED_CAP = 10
MAX_SUBQUERIES = 3
MAX_ROUNDS = 2
SNIPPET_CHARS = 500
SOURCE_WORDING = {"generic": "tài liệu", "numbered": "tài liệu #", "prefix": "nguồn: "}
GROUP_WORDING = {"generic": "Tài liệu", "numbered": "Tài liệu #"}
NO_CONTEXT_ANSWER = (
    "Xin lỗi, hiện chưa tìm thấy tài liệu phù hợp để trả lời câu hỏi này. "
    "Phụ huynh vui lòng liên hệ trực tiếp nhà trường để được hỗ trợ chính xác."
)

# --- fixed values: evaluation --------------------------------------------------------------------
ALPHA_GRID = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
K_GRID = (1, 3, 5, 8, 10, 15, 20, 30, 50)
MAX_K = 50
K_SELECT = 10
POOL_DEPTH = 30
RERANK_CURVE_N = 15
OVERLAP_THRESHOLD = 0.5
RARE_DF = 3
TOPK_GRID = (5, 8, 10, 15, 20, 30, 40, 50)
TOPN_GRID = (1, 2, 3, 4, 5, 6, 8, 10)
TOPN_FOCUS = 4
SATURATION = 0.99
NO_SOURCE = "none"

# --- fixed values: usage -------------------------------------------------------------------------
RANGE_HOURS = {"24h": 24, "7d": 168, "30d": 720}
BUCKETS = 6
HISTORY_MESSAGES = 5
TITLE_CHARS = 60
LAST_MESSAGE_CHARS = 120

# --- fixed values: quality -----------------------------------------------------------------------
HEAVY_FLAGS = ("TABLE_NO_DATA", "CONTEXT_IN_CONTENT")
