"""The taxonomy dimension: administrative domains by code, group and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: the registry, in order
TAXONOMY = [
    ("TCNS_THU_CHI", "Thu chi Ngân sách Nhà nước", "TAI_CHINH_NGAN_SACH", ["thu ngân sách", "chi ngân sách", "quyết toán", "dự toán", "kho bạc", "hụt thu", "vốn đối ứng"]),
    ("TCNS_TAI_SAN_CONG", "Quản lý Tài sản công & Giá", "TAI_CHINH_NGAN_SACH", ["tài sản công", "định giá", "đấu thầu", "mua sắm công", "thẩm định giá"]),
    ("DTC_GIAI_NGAN", "Giải ngân Kế hoạch Vốn Đầu tư công", "DAU_TU_CONG", ["đầu tư công", "kế hoạch vốn", "giải ngân", "vốn ngân sách trung ương", "vốn ngân sách tỉnh", "chủ trương đầu tư"]),
    ("DTC_TIEN_DO_DU_AN", "Tiến độ Thi công & Công trình Trọng điểm", "DAU_TU_CONG", ["tiến độ thi công", "nghiệm thu", "bàn giao đưa vào sử dụng", "chậm tiến độ", "nhà thầu", "gói thầu"]),
    ("TNMT_GPMB", "Bồi thường, Giải phóng Mặt bằng & Tái định cư", "TAI_NGUYEN_MOI_TRUONG", ["giải phóng mặt bằng", "gpmb", "thu hồi đất", "bồi thường", "hỗ trợ tái định cư", "bàn giao mặt bằng"]),
    ("TNMT_DAT_DAI", "Quản lý Đất đai & Cấp GCNQSDĐ", "TAI_NGUYEN_MOI_TRUONG", ["đất đai", "sổ đỏ", "gcnqsdđ", "chuyển mục đích sử dụng đất", "đấu giá quyền sử dụng đất", "vi phạm đất đai"]),
    ("TNMT_MOI_TRUONG", "Bảo vệ Môi trường & Xử lý Rác thải", "TAI_NGUYEN_MOI_TRUONG", ["môi trường", "rác thải", "nước thải", "ô nhiễm", "quan trắc môi trường", "thu gom rác"]),
    ("CCHC_DVC_TRUC_TUYEN", "Dịch vụ công Trực tuyến & Một cửa", "CAI_CACH_HANH_CHINH", ["cải cách hành chính", "cchc", "bộ phận một cửa", "dịch vụ công trực tuyến", "hồ sơ trực tuyến", "số hóa hồ sơ"]),
    ("CCHC_TIEN_DO_GIAI_QUYET", "Tiến độ Giải quyết Hồ sơ & Mức độ Hài lòng", "CAI_CACH_HANH_CHINH", ["giải quyết đúng hạn", "hồ sơ trễ hạn", "quá hạn", "mức độ hài lòng", "xin lỗi người dân"]),
    ("TU_PHAP_HO_TICH", "Đăng ký Hộ tịch & Chứng thực", "NOI_CHINH_TU_PHAP", ["tư pháp", "hộ tịch", "khai sinh", "khai tử", "kết hôn", "chứng thực bản sao", "chữ ký"]),
    ("TU_PHAP_VBQPPL", "Xây dựng, Thẩm định & Rà soát VBQPPL", "NOI_CHINH_TU_PHAP", ["văn bản quy phạm pháp luật", "vbqppl", "thẩm định văn bản", "rà soát văn bản", "tuyên truyền phổ biến pháp luật"]),
    ("TCD_KNTC", "Tiếp công dân & Giải quyết Khiếu nại, Tố cáo", "NOI_CHINH_TU_PHAP", ["tiếp công dân", "khiếu nại", "tố cáo", "đơn thư", "đoàn đông người", "bức xúc kéo dài"]),
    ("PCTN_THANH_TRA", "Thanh tra, Kiểm tra & Phòng chống Tham nhũng", "NOI_CHINH_TU_PHAP", ["phòng chống tham nhũng", "pctn", "thanh tra", "kiểm tra", "kê khai tài sản", "sai phạm kinh tế"]),
    ("Y_TE_KHAM_CHUA_BENH", "Khám chữa bệnh & Y tế Dự phòng", "Y_TE_SUC_KHOE", ["y tế", "khám chữa bệnh", "bệnh viện", "trạm y tế", "dịch bệnh", "tiêm chủng", "bảo hiểm y tế"]),
    ("PCTT_SU_CO", "Phòng chống Thiên tai, Bão lũ & Tìm kiếm Cứu nạn", "QUOC_PHONG_AN_NINH", ["thiên tai", "bão lũ", "ngập lụt", "sạt lở", "cháy rừng", "cứu hộ", "thiệt hại tài sản", "sơ tán dân"]),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(TAXONOMY)], "ord int, code string, name string, parent_group string, keywords array<string>")
