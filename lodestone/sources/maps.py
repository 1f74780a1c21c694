"""Records of map formats: albums, layer styles, and maps with the texts of their layers. Strings are GB18030, numbers little-endian."""

from __future__ import annotations

import re
import struct
from pathlib import PurePosixPath

import numpy as np

from .plain import Source

# What files begin with, places, sizes and limits of records.
MAP, LAYER, STYLE, ALBUM = b"Geomap v3.60 Map\x00", b"Geomap v3.60 Layer\x00\x00", b"Geomap v3.60 LayerStyle\x00", b"GeoMap Album Information\n"
ALBUM_TREE, MOST_STRING, MOST_CATEGORIES, MOST_ITEMS = 2048, 1 << 20, 10_000, 100_000
CATEGORY_NODE, ITEM_NODE = 3, 1
STYLE_COUNT, STYLE_HEAD, STYLE_RECORD = 512, 516, 524
STYLE_SLOTS = ((0, 64), (80, 64), (160, 64), (240, 64), (320, 64), (400, 64), (480, 32))
MAP_NAME, LAYER_HEAD, LAYER_NAME_SIZE, LAYER_NAME, MOST_NAME = slice(0x204, 0x304), 2048, 0x362, 0x366, 256
OBJECT_TEXT, MOST_TEXT, MOST_ATTRIBUTES = b"\x2f\x3d\x50\x75", 1024, 100_000
# Lines of what is made.
STYLE_TITLES = "记录号\t图层或属性组\t属性字段1\t属性字段2\t属性字段3\t属性字段4\t属性字段5\t属性字段6"
ENCODING_LINE = "字符编码: GBK/GB18030"


class _Tree:
    """Reads numbers and strings from a place on; what goes beyond the file is an error."""

    def __init__(self, content: bytes, at: int):
        self.content, self.at = content, at

    def take(self, n: int) -> bytes:
        got = self.content[self.at : self.at + n]
        if len(got) < n:
            raise ValueError(f"{n} bytes are wanted at {self.at}, where the file has {len(got)}")
        self.at += n
        return got

    def number(self, most: int | None = None, only: int | None = None) -> int:
        (value,) = struct.unpack("<I", self.take(4))
        if most is not None and value > most or only is not None and value != only:
            raise ValueError(f"{value} can't stand at {self.at - 4}")
        return value

    def string(self) -> str:
        raw = self.take(self.number(MOST_STRING))
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError as e:
            raise ValueError(f"no string ends at {self.at}") from e


def album(name: str, content: bytes) -> list[Source]:
    """A source about the album, and one for each of its maps."""
    if len(content) <= ALBUM_TREE:
        raise ValueError("the album has no tree")
    tree = _Tree(content, ALBUM_TREE)
    stored, flags, title = tree.string(), tree.number(), tree.string()
    title = title or stored
    categories, items = tree.number(MOST_CATEGORIES), []
    for _ in range(categories):
        tree.number(only=CATEGORY_NODE)
        category = tree.string()
        for _ in range(tree.number(MOST_ITEMS)):
            tree.number(only=ITEM_NODE)
            items.append((category, tree.string(), tree.string().replace("\\", "/").strip("/"), tree.string()))
    if tree.at != len(content):
        raise ValueError(f"{len(content) - tree.at} bytes follow the album's tree")
    about = [f"文件名: {name}", "格式: GeoMap Album Information 图册信息文件", ENCODING_LINE, f"图册名: {title}", f"分类数: {categories}", f"图件数: {len(items)}", f"图册标志: {flags}"]
    out: list[Source] = [(None, "GeoMap Album Information", "\n".join(about))]
    for category, shown, folder, database in items:
        lines = [f"图册: {title}", f"分类: {category}", f"图件显示名: {shown}", f"相对目录: {folder or '.'}", f"GeoMap 数据库文件: {database}", f"完整相对路径: {'/'.join(filter(None, [folder, database]))}"]
        out.append((None, f"GeoMap图册/{category}/{shown}", "\n".join(lines)))
    return out


def _readable(text: str, marks: str, least: float) -> bool:
    """Whether enough of the characters are letters, digits or the given marks."""
    return bool(text) and sum(c.isalnum() or c in marks for c in text) >= least * len(text)


def _slot(raw: bytes) -> str:
    """The text of a slot of fixed width, which a zero byte ends; '' if it isn't readable."""
    try:
        text = raw.partition(b"\x00")[0].decode("gb18030").strip()
    except UnicodeDecodeError:
        return ""
    return text if _readable(text, "._- /", 0.7) and min(text) >= " " else ""


def layer_styles(name: str, content: bytes) -> list[Source]:
    """A table with a row for each record."""
    count, left = divmod(len(content) - STYLE_HEAD, STYLE_RECORD)
    if count <= 0 or left:
        raise ValueError(f"what follows the head isn't made of records of {STYLE_RECORD} bytes")
    (told,) = struct.unpack_from("<I", content, STYLE_COUNT)
    if told and told != count:
        raise ValueError(f"the head tells of {told} records, the file has {count}")
    rows = []
    for n in range(1, count + 1):
        record = content[STYLE_HEAD + (n - 1) * STYLE_RECORD :][:STYLE_RECORD]
        fields = "\t".join(_slot(record[at : at + width]) for at, width in STYLE_SLOTS).rstrip("\t")
        rows.append(f"{n}\t{fields or f'图层_{n}'}")
    about = [f"文件名: {name}", "格式: Geomap v3.60 LayerStyle 属性数据表", ENCODING_LINE, f"LayerStyle 记录数: {count}", f"固定记录长度: {STYLE_RECORD} 字节", "说明: 每行对应同序号 GDB 图层的样式或属性字段定义。", "属性数据表:", STYLE_TITLES]
    return [(None, "GeoMap属性表/LayerStyle", "\n".join(about + rows))]


#: What a text is taken for an attribute by, if no mark stands before it: two Chinese characters, numbers, or a name.
ATTRIBUTE = re.compile(r"(?=.*[一-鿿].*[一-鿿]).*|[-+]?\d+(?:\.\d+)?(?:[|/]\d+)*|[A-Za-z][A-Za-z0-9_.-]{2,}")


def attributes(body: bytes) -> list[str]:
    """Texts with their size before them, in order and without overlaps. Those 4 or 12 bytes after the start of a mark are taken if they are readable, others if they look like an attribute."""
    n = len(body) - 3
    if n <= 0:
        return []
    data = np.frombuffer(body, np.uint8)
    size = sum(data[i : n + i].astype(np.int64) << (8 * i) for i in range(4))
    begin = np.arange(4, n + 4)
    end = begin + size
    fits = (size > 0) & (size <= MOST_TEXT) & (end <= len(body))
    controls = np.concatenate([[0], np.cumsum(data < 32)])
    fits[fits] = controls[end[fits]] == controls[begin[fits]]
    marked = {m.start() + gap for m in re.finditer(re.escape(OBJECT_TEXT), body) for gap in (4, 12)}
    out, free = [], 0
    for at in np.flatnonzero(fits).tolist():
        if at < free:
            continue
        try:
            text = " ".join(body[at + 4 : end[at]].decode("gb18030").split())
        except UnicodeDecodeError:
            continue
        if text.isprintable() and _readable(text, " ._-/|#()（）+%", 0.85) and (at in marked or ATTRIBUTE.fullmatch(text)):
            out.append(text)
            free = int(end[at])
    return out


def _layer_name(layer: bytes, number: int) -> str:
    if len(layer) < LAYER_NAME:
        raise ValueError(f"layer {number} has no name")
    (size,) = struct.unpack_from("<I", layer, LAYER_NAME_SIZE)
    if not 0 < size <= MOST_NAME or LAYER_NAME + size > min(LAYER_HEAD, len(layer)):
        raise ValueError(f"the name of layer {number} can't have {size} bytes")
    try:
        return layer[LAYER_NAME : LAYER_NAME + size].decode("gb18030").strip() or f"图层_{number}"
    except UnicodeDecodeError as e:
        raise ValueError(f"the name of layer {number} isn't GB18030") from e


def layers(name: str, content: bytes) -> list[Source]:
    """A source about the map, and one with the attributes of each layer."""
    starts = [m.start() for m in re.finditer(re.escape(LAYER), content)]
    if not starts:
        raise ValueError("the map has no layers")
    found, total = [], 0
    for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(content)], strict=True), 1):
        layer = content[a:b]
        title = _layer_name(layer, number)
        if len(layer) < LAYER_HEAD and number < len(starts):
            raise ValueError(f"layer {number} is shorter than its head")
        own = attributes(layer[LAYER_HEAD:])
        total += len(own)
        if total > MOST_ATTRIBUTES:
            raise ValueError(f"the map has more than {MOST_ATTRIBUTES} attributes")
        found.append((title, own))
    about = [f"文件名: {name}", "格式: Geomap v3.60 Map 属性数据表", ENCODING_LINE, f"图名: {_slot(content[MAP_NAME]) or PurePosixPath(name).stem}", f"图层数: {len(found)}", f"提取的文本或数值属性记录数: {total}", "说明: 仅提取图层名称及对象中的文本、数值属性；图形坐标和二进制样式不作为文本入库。"]
    out: list[Source] = [(None, "GeoMap属性表/概览", "\n".join(about))]
    for number, (title, own) in enumerate(found, 1):
        rows = [f"{i}\t{v}" for i, v in enumerate(own, 1)] or ["-\t本图层没有可直接提取的文本或数值属性"]
        head = ["GeoMap 图层属性数据表", f"图层序号: {number}/{len(found)}", f"图层名称: {title}", f"属性记录数: {len(own)}", "记录号\t属性值"]
        out.append((None, f"GeoMap属性表/{number:03d}/{title}", "\n".join(head + rows)))
    return out
