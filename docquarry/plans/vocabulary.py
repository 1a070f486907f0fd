"""Words that questions about tables are understood by."""

from __future__ import annotations

# The words and expressions below are part of the expected behaviour.
STOPWORDS = frozenset(
    "cho tôi bạn em chị thầy về của và các có là không gì nào thế này một những được với hoặc hay ra lên xuống qua lại"
    " khi đã đang sẽ số mấy nhiêu bao biết xin hãy hỏi giúp ơn ạ à thì mà ở tại trong ngoài trên dưới cả rất lắm quá nữa"
    " vẫn cứ lớp môn học phần dạy dành sinh viên file tệp thời khóa biểu thoi khoa bieu".split()
)
FILTER_WORDS = frozenset(
    "ai người nguoi nào nao lớn lon tuổi tuoi cao già gia nhỏ nho trẻ tre ít it nhất nhat danh sách sach thông tin thong"
    " so sánh sanh tổng tong trung bình binh thấp thap".split()
)
#: Intent and expression; the first that matches decides.
INTENTS = (
    ("SUM", r"(tổng|cộng)\s+(của|số)?"),
    ("AVG", r"trung\s*bình"),
    ("MAX", r"(cao|nhiều|lớn|dài|rộng|nặng|sâu).{0,6}(nhất)"),
    ("MIN", r"(thấp|ít|ngắn|hẹp|nhẹ|nhỏ|nông|cạn).{0,6}(nhất)"),
    ("COUNT", r"(bao.?nhiêu|mấy|đếm|số.?lượng|có\s.*không)"),
    ("COMPOUND", r"(vừa|đồng.?thời|cả).{1,40}(vừa|cả|mà)"),
    ("COMPARE", r"(so.?sánh|khác.?nhau|chênh.?lệch|nhiều.?hơn|ít.?hơn)"),
    ("ANALYSIS", r"(phân.?tích|tổng.?quan|thống.?kê|lên.?kế.?hoạch|tạo.*plan)"),
    ("FILTER", r"(điều.?kiện|lọc|filter|trong.?đó)"),
    ("GROUP", r"(group|nhóm|phân.?loại|chia.?loại|theo.?từng)"),
)
ALIASES = {
    "person_name": ["ho ten", "ten nguoi", "can bo", "giang vien", "hoc vien", "sinh vien", "nhan su"],
    "date_of_birth": ["ngay sinh", "sinh ngay", "dob", "birthday", "tuoi", "lon tuoi", "cao tuoi"],
    "birth_year": ["nam sinh", "birth year", "tuoi", "lon tuoi", "cao tuoi"],
    "age": ["tuoi", "age", "lon tuoi", "cao tuoi"],
    "degree": ["hoc vi", "trinh do", "bang cap", "thac si", "tien si", "dai hoc", "degree"],
    "education_level": ["trinh do", "dao tao", "he dao tao", "chuong trinh", "hoc", "thac si"],
    "course_code": ["ma hoc phan", "ma hp", "ma mon", "course code"],
    "course_name": ["hoc phan", "ten mon", "mon hoc", "course name"],
    "class_name": ["lop", "lop hoc", "nhom lop", "class"],
    "credit": ["tin chi", "tc", "so tin chi", "credit"],
    "quantity": ["so luong", "si so", "ss", "quantity", "count"],
    "teacher": ["giang vien", "giao vien", "can bo giang day", "pcgd", "teacher"],
    "department": ["khoa", "bo mon", "don vi", "phong ban", "department"],
    "gender": ["gioi tinh", "nam", "nu", "male", "female", "sex"],
    "generic_text": [],
    "generic_number": [],
}
#: Semantic type, confidence, parts of the compact column name, whole names; the first that fits decides.
NAMED = (
    ("date_of_birth", 0.95, ("ngaysinh", "ngaythangnamsinh", "sinhngay", "dob", "birthday"), ()),
    ("birth_year", 0.95, ("namsinh", "birthyear"), ()),
    ("age", 0.95, ("tuoi",), ("age",)),
    ("person_name", 0.9, ("hoten", "hovaten", "tennguoi", "hocvien", "sinhvien", "canbo"), ()),
    ("degree", 0.9, ("hocvi", "trinhdo", "bangcap", "hedaotao", "chuongtrinh"), ()),
    ("course_code", 0.9, ("mahp", "mahocphan", "mamon", "coursecode"), ()),
    ("course_name", 0.85, ("tenmon", "monhoc", "hocphan", "coursename"), ()),
    ("class_name", 0.8, ("lop",), ("class",)),
    ("credit", 0.9, ("tinchi", "sotinchi", "credit"), ("tc",)),
    ("quantity", 0.85, ("soluong", "siso", "quantity"), ("ss",)),
    ("teacher", 0.85, ("giangvien", "giaovien", "pcgd", "teacher"), ()),
    ("department", 0.8, ("khoa", "bomon", "donvi", "phongban", "department"), ()),
    ("gender", 0.95, ("gioitinh", "gender", "sex"), ()),
)
#: What a question is about follows one of these; with accents before without.
ABOUT = (
    r"(?:thông\s*tin\s*về|biết\s*về|nói\s*về|về)\s+(.+)$",
    r"(?:thong\s*tin\s*ve|biet\s*ve|noi\s*ve|ve)\s+(.+)$",
)
#: Words with which a question goes on to something else.
GOES_ON = r"\b(?:và|va|đồng thời|dong thoi|còn|con|ai là|ai la|có bao nhiêu|co bao nhieu)\b"
COMPARED = r"(?:so\s*sánh|so\s*sanh)\s+(.+)$"
BETWEEN_COMPARED = r"\s+(?:và|va|với|voi)\s+"
BETWEEN_PARTS = r"\s+(?:và|va|đồng thời|dong thoi)\s+"
KEYWORD = r"[A-Za-z0-9\u00C0-\u1EF9]+"
#: Task and expression over the normalised part of a question; the first that matches decides.
PART_RULES = (
    ("oldest", r"\b(?:lon tuoi nhat|cao tuoi nhat|gia nhat)\b"),
    ("youngest", r"\b(?:nho tuoi nhat|it tuoi nhat|tre nhat)\b"),
    ("gender", r"\b(?:nam|nu|male|female)\b"),
    ("count", r"\b(?:bao nhieu|so luong|dem|may)\b"),
    ("sum", r"\b(?:tong|cong)\b"),
    ("avg", r"trung binh"),
    ("max", r"\b(?:cao nhat|lon nhat|nhieu nhat)\b"),
    ("min", r"\b(?:thap nhat|it nhat|nho nhat)\b"),
)
#: Words of a question for how many, and expressions for women and men.
HOW_MANY = ("bao nhieu", "so luong", "dem")
WOMEN, MEN = r"\b(nu|female)\b", r"\b(nam|male)\b"
#: What a measure is called where it means age.
AGE_WORDS = ("tuoi", "sinh", "birth", "age")
#: What stands above the result of a task; ``{}`` is what the task is about.
TITLES = {
    "lookup": "Thông tin về {}:",
    "compare": "Kết quả so sánh:",
    "oldest": "Người lớn tuổi nhất phù hợp điều kiện:",
    "youngest": "Người nhỏ tuổi nhất phù hợp điều kiện:",
    "group_count": "Thống kê theo {}:",
    "aggregate": "Kết quả tính toán:",
    "extreme": "Kết quả tìm giá trị phù hợp:",
    "count": "Kết quả đếm:",
    "gender_count": "Thống kê giới tính:",
    "sum": "Kết quả tính tổng:",
    "avg": "Kết quả trung bình:",
    "max": "Giá trị cao nhất:",
    "min": "Giá trị thấp nhất:",
}
TITLE, GROUP = "Kết quả:", "nhóm"
