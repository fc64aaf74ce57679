"""Fields of a product title: kind, amount, variant, pieces and the name that is left."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words for one kind of product in English, Indonesian and Vietnamese.
KINDS = {
    "mug": "ceramic mug|coffee mug|mug keramik|cangkir keramik|cốc sứ|ly sứ",
    "charger": "wall charger|charger adapter|power adapter|adaptor cas|kepala charger|củ sạc|cốc sạc nhanh|cốc sạc",
    "cable": "usb cable|charging cable|kabel usb|kabel cas|cáp sạc|dây sạc usb|dây sạc",
    "powerbank": "power bank|portable battery|bank daya|sạc dự phòng|pin dự phòng",
    "tripod": "phone tripod|tripod stand|tripod hp|tiang tripod|chân máy điện thoại|giá đỡ điện thoại|giá đỡ|tripod",
    "lamp": "led lamp|led bulb|lampu led|bohlam led|bóng đèn led|đèn led",
    "towel": "bath towel|handuk mandi|handuk|khăn tắm|khăn lông|towel",
    "shirt": "cotton t shirt|tee shirt|t shirt|kaos katun|baju kaos|kaos|áo thun|áo phông cotton|áo phông",
    "shoes": "running shoes|sneakers|sepatu lari|sepatu kets|giày chạy bộ|giày thể thao",
    "cooker": "rice cooker|electric rice pot|penanak nasi|magic com|nồi cơm điện|nồi nấu cơm",
    "cashew": "cashew nuts|roasted cashews|kacang mete|mete panggang|hạt điều rang|hạt điều",
    "coffee": "ground coffee|coffee powder|kopi bubuk|kopi giling|cà phê bột|cà phê xay",
    "shampoo": "hair shampoo|shampoo|sampo|shampo rambut|shampo|dầu gội đầu|dầu gội",
    "lotion": "hand and body lotion|body lotion|hand body|losion badan|sữa dưỡng thể|kem dưỡng thể",
    "serum": "face serum|facial serum|serum wajah|serum muka|serum dưỡng da|tinh chất dưỡng da",
    "detergent": "liquid detergent|laundry liquid|deterjen cair|sabun cuci cair|nước giặt xả|nước giặt",
}
# Colours and flavours in the three languages.
VARIANTS = {
    "black": "black|hitam|đen", "white": "white|putih|trắng", "red": "red|merah|đỏ",
    "navy": "navy|biru dongker|xanh than", "green": "green|hijau|xanh lá", "yellow": "yellow|kuning|vàng",
    "purple": "purple|ungu|tím", "pink": "pink|merah muda|hồng", "brown": "brown|cokelat|nâu",
    "grey": "grey|gray|abu abu|xám", "mint": "daun mint|mint|bạc hà", "lemon": "lemon|chanh",
    "rose": "rose|mawar|hoa hồng", "vanilla": "vanilla|vanila|vani", "honey": "honey|madu|mật ong",
    "greentea": "green tea|teh hijau|trà xanh", "coconut": "coconut|kelapa|dừa", "ginger": "ginger|jahe|gừng",
    "original": "original|orisinal|nguyên bản", "blue": "blue|biru|xanh dương", "orange": "orange|oranye|cam",
}
# Phrases that praise or offer and say nothing about the product.
PRAISE = (
    "chính hãng|promo murah|limited promo|promo|"
    "ready stock|ready stok|ready|cod available|bisa cod|cod|hot sale|flash deal|sale|best seller|terlaris|"
    "diskon gede|gratis ongkir|kualitas premium|cuci gudang|paling dicari|garansi resmi|terbaru|free shipping|"
    "buyers choice|new arrival|official store|top quality|siêu hot|xả kho|giảm sốc|giá rẻ|khuyến mãi|hàng mới về|"
    "sẵn hàng|miễn phí vận chuyển|bán chạy|cao cấp|bảo hành|freeship|murah|diskon|gratis|hot|giá sốc|new"
)
# Units, their base unit and factor.
UNITS = {
    "ml": ("ml", 1), "mililiter": ("ml", 1), "milliliter": ("ml", 1), "l": ("ml", 1000), "ltr": ("ml", 1000),
    "liter": ("ml", 1000), "litre": ("ml", 1000), "lít": ("ml", 1000), "g": ("g", 1), "gr": ("g", 1),
    "gram": ("g", 1), "grams": ("g", 1), "kg": ("g", 1000), "kilo": ("g", 1000), "cm": ("cm", 1),
    "senti": ("cm", 1), "m": ("cm", 100), "mtr": ("cm", 100), "meter": ("cm", 100), "mét": ("cm", 100),
    "w": ("w", 1), "watt": ("w", 1), "mah": ("mah", 1),
}

_NUMBER = r"(\d+(?:[.,]\d+)*)"
_UNIT = re.compile(rf"(?<![\w.,]){_NUMBER}\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\w)")
_WEAR = re.compile(r"(?<!\w)(?:size|sz|uk|ukuran|eu|no|cỡ|nomor|số)[ .]*(\d{2}|xxxl|xxl|xl|xs|s|m|l)(?!\w)")
_PIECES = (
    re.compile(r"(?<!\w)(?:set of|pack of|paket|isi|combo|bộ|lot of|set)\s*(\d{1,3})(?!\w)"),
    re.compile(r"(?<!\w)(\d{1,3})\s*-?\s*(?:pcs|pc|pieces|piece|buah|cái|packs|pack|chiếc|biji)(?!\w)"),
    re.compile(r"(?<!\w)x([2-9]|1[0-2])(?!\w)"),  # a longer number after x is a model code
)
_CODE = re.compile(r"(?<!\w)([a-z])[ -]?(\d{2,4})(?!\w)")
_OTHER = re.compile(r"\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+")


def _phrases(groups: dict[str, str]) -> tuple[re.Pattern, dict[str, str]]:
    names = {p: k for k, v in groups.items() for p in v.split("|")}
    longest = sorted(names, key=lambda p: (-len(p), p))
    return re.compile(rf"(?<!\w)(?:{'|'.join(longest)})(?!\w)"), names


_KIND, _KIND_OF = _phrases(KINDS)
_VARIANT, _VARIANT_OF = _phrases(VARIANTS)
_PRAISE = re.compile(rf"(?<!\w)(?:(?:original|ori|chính hãng)\s*100\s*%|100\s*%\s*(?:original|ori|chính hãng)(?!\w)|(?:{'|'.join(sorted(PRAISE.split('|'), key=lambda p: (-len(p), p)))})(?!\w))")
_JOINED = re.compile(r"(?<=[^\W\d_])-(?=[^\W\d_])")


def number(text: str, unit: str) -> float:
    """Value of a written number; a group of three digits is a thousand unless the unit is large."""
    if re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", text) and UNITS[unit][1] == 1 and not text.startswith("0"):
        return float(re.sub(r"[.,]", "", text))
    head, _, tail = text.replace(",", ".").rpartition(".")
    return float(f"{head.replace('.', '')}.{tail}") if head else float(tail)


@lru_cache(maxsize=200_000)
def fields(title: str) -> tuple[str, str, str, int, str, str]:
    """``kind, amount, variant, pieces, code, name`` of a title; what it lacks is empty (pieces: 1).

    ``name`` holds the remaining words in their order, parted by blanks; a word
    broken by a hyphen is one word.  Numbers with a unit or meaning that no list
    knows are kept, in order of size, as further parts of ``amount``; their
    units stay words of the name.
    """
    t = unicodedata.normalize("NFKC", title).casefold()
    t = t.replace("abu-abu", "abu abu").replace("t-shirt", "t shirt")
    t = re.sub(r"\[[^\]]*\]|\*[^*]*\*|\([^)]*\)", lambda m: f" {m[0][1:-1]} ", t)
    amount, variant, pieces, kind, code = "", "", 0, "", ""

    def unit(m: re.Match) -> str:
        nonlocal amount
        base, factor = UNITS[m[2]]
        amount = amount or f"{round(number(m[1], m[2]) * factor, 3):g}{base}"
        return " | "

    def wear(m: re.Match) -> str:
        nonlocal amount
        amount = amount or f"size {m[1]}"
        return " | "

    def count(m: re.Match) -> str:
        nonlocal pieces
        pieces = pieces or int(m[1])
        return " | "

    def named(m: re.Match) -> str:
        nonlocal code
        code = code or f"{m[1]}{m[2]}"
        return " | "

    def of(m: re.Match) -> str:
        nonlocal kind
        kind = kind or _KIND_OF[m[0]]
        return " | "

    def tint(m: re.Match) -> str:
        nonlocal variant
        variant = variant or _VARIANT_OF[m[0]]
        return " | "

    t = _PRAISE.sub(" | ", " ".join(t.split()))
    t = _VARIANT.sub(tint, _KIND.sub(of, t))
    for p in _PIECES:
        t = p.sub(count, t)
    t = _CODE.sub(named, _WEAR.sub(wear, _UNIT.sub(unit, t)))
    others = sorted({m.replace(",", ".") for m in _OTHER.findall(t)}, key=lambda n: (len(n), n))
    if others:
        amount = " ".join([amount, *others]).strip()
    name = " ".join(_WORD.findall(_JOINED.sub("", t)))
    return kind, amount, variant, pieces or 1, code, name
