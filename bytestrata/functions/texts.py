"""Scalar functions on names, sizes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by structure name; all others are application/octet-stream.
MIME = {
    "gzip": "application/gzip", "xz": "application/x-xz", "lzma": "application/x-lzma", "bzip2": "application/x-bzip2", "zstd": "application/zstd", "lz4": "application/x-lz4", "lz4_legacy": "application/x-lz4",
    "zip": "application/zip", "tar": "application/x-tar", "cpio": "application/x-cpio", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "pdf": "application/pdf",
    "elf": "application/x-executable", "upx": "application/x-upx", "ihex": "text/x-hex", "iso9660": "application/x-iso9660-image", "certificate": "application/x-x509-ca-cert", "verity": "application/x-verity-hash",
    "private_key": "application/x-pem-file", "rpi_eeprom": "application/x-raspberry-eeprom",
    "squashfs": "application/x-squashfs", "squashfs_legacy": "application/x-squashfs", "ext": "application/x-ext", "f2fs": "application/x-f2fs", "jffs2": "application/x-jffs2", "ubi": "application/x-ubi", "ubifs": "application/x-ubifs",
    "yaffs2": "application/x-yaffs2", "cramfs": "application/x-cramfs", "erofs": "application/x-erofs", "romfs": "application/x-romfs", "btrfs": "application/x-btrfs", "xfs": "application/x-xfs", "hfsplus": "application/x-hfsplus",
    "fat": "application/x-fat", "fat32": "application/x-fat", "exfat": "application/x-exfat", "ntfs": "application/x-ntfs", "nilfs2": "application/x-nilfs2", "minix": "application/x-minix-fs", "reiserfs": "application/x-reiserfs",
    "ufs": "application/x-ufs", "apfs": "application/x-apfs", "logfs": "application/x-logfs", "littlefs": "application/x-littlefs", "spiffs": "application/x-spiffs",
    "android_boot": "application/x-android-bootimg", "android_sparse": "application/x-android-sparse", "uimage": "application/x-uimage", "fit": "application/x-flat-image-tree", "dtb": "application/x-dtb", "uboot": "application/x-uboot",
    "uboot_env": "application/x-uboot-env", "vbmeta": "application/x-avb-vbmeta", "uefi_fv": "application/x-uefi-firmware-volume", "lk": "application/x-lk-bootloader", "mtk_lk": "application/x-mediatek-lk-bootloader",
    "gpt": "application/x-gpt", "mbr": "application/x-mbr", "esp32_partition_table": "application/x-esp32-partition-table", "esp32_nvs": "application/x-esp32-nvs", "luks1": "application/x-luks", "luks2": "application/x-luks",
}


def mime(type_: Column) -> Column:
    """FN-9."""
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, type_), F.lit("application/octet-stream"))


def tier_name(confidence: Column) -> Column:
    """FN-8."""
    return F.when(confidence >= 99, "verified").when(confidence >= 85, "consistent").when(confidence >= 60, "structural").when(confidence >= 25, "magic").otherwise("reject")


def hex_offset(offset: Column) -> Column:
    """FN-17: 0x and at least eight digits."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(offset), 8, "0")))


def human_size(size: Column) -> Column:
    """FN-17: bytes in the largest binary unit that leaves one or more, with one decimal above bytes."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for unit, bits in (("KiB", 10), ("MiB", 20), ("GiB", 30)):
        out = F.when(size >= 1 << bits, F.concat(F.format_string("%.1f", size / (1 << bits)), F.lit(f" {unit}"))).otherwise(out)
    return out


def safe_label(text: Column) -> Column:
    """FN-18: what a file name may hold."""
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")


def blob_name(offset: Column, type_: Column) -> Column:
    """SNK-6: the name of a carved range."""
    return F.concat(hex_offset(offset), F.lit("-"), safe_label(type_), F.lit(".bin"))


def json_escape(text: Column) -> Column:
    """FN-11: a text whose characters stand for bytes, as it stands in a JSON document: quotes, backslashes, what is below
    U+0020 and what is above U+007E are escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def one(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when((code < 0x20) | (code > 0x7E), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))).otherwise(c)
        for raw, escaped in short.items():
            out = F.when(c == raw, escaped).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
