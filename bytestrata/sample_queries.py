"""Queries over the sample images: every format is identified, unpacked, listed and carved; the SQL states what must come out.

The SQL's contents are spelled out, their digests computed there; nothing in it is taken from what the code returns.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blob_queries import _packaged
from .functions import checksums, ciphers, codecs, expr, layout, lzari, lzo, validators
from .functions.texts import human_size, json_escape
from .operators import containers, embedded, extract, identify, listing, reports, sinks, summaries
from .queries import _query
from .samples import images, packs, stores, volumes
from .sources import blobs, catalog, tables


@cache
def _images() -> dict[str, bytes]:
    return {name: build() for name, build in {**images.SAMPLES, **stores.SAMPLES, **packs.SAMPLES, **volumes.SAMPLES}.items()}


def _samples(spark: SparkSession, *names: str) -> DataFrame:
    """sample, blob_id and content of some samples, or all."""
    rows = [(k, name, bytearray(data)) for k, (name, data) in enumerate(_images().items()) if not names or name in names]
    return spark.createDataFrame(rows, "blob_id long, sample string, content binary")


def _findings(spark: SparkSession, *names: str) -> DataFrame:
    blobs = _samples(spark, *names)
    return identify.identify(blobs, _packaged()).join(blobs.select("blob_id", "sample"), "blob_id")


_IDENTIFIED = """(VALUES
    ('gpt.bin', 'gpt', 'container', 512, 92, 'verified'), ('mbr.bin', 'mbr', 'container', 0, 512, 'consistent'), ('mbr.bin', 'mbr', 'container', 8192, 512, 'consistent'), ('esp32_part.bin', 'esp32_partition_table', 'container', 32768, 96, 'consistent'),
    ('esp32_nvs.bin', 'esp32_nvs', 'container', 0, 4096, 'verified'), ('littlefs.bin', 'littlefs', 'filesystem', 0, 16384, 'verified'), ('nilfs2.bin', 'nilfs2', 'filesystem', 0, 65536, 'verified'), ('minix.bin', 'minix', 'filesystem', 0, 65536, 'consistent'),
    ('reiserfs.bin', 'reiserfs', 'filesystem', 65536, 81920, 'consistent'), ('ufs.bin', 'ufs', 'filesystem', 8192, 8192, 'consistent'), ('apfs.bin', 'apfs', 'filesystem', 0, 65536, 'consistent'), ('logfs.bin', 'logfs', 'filesystem', 0, 512, 'consistent'),
    ('luks1.bin', 'luks1', 'encrypted', 0, 4096, 'consistent'), ('luks2.bin', 'luks2', 'encrypted', 0, 16384, 'consistent'), ('squashfs.bin', 'squashfs', 'filesystem', 0, 1456, 'consistent'), ('squashfs_be.bin', 'squashfs', 'filesystem', 0, 1674, 'consistent'),
    ('ext.bin', 'ext', 'filesystem', 0, 65536, 'consistent'), ('erofs.bin', 'erofs', 'filesystem', 0, 32768, 'consistent'), ('f2fs.bin', 'f2fs', 'filesystem', 0, 8192, 'consistent'), ('hfsplus.bin', 'hfsplus', 'filesystem', 0, 32768, 'consistent'),
    ('xfs.bin', 'xfs', 'filesystem', 0, 32768, 'consistent'), ('btrfs.bin', 'btrfs', 'filesystem', 0, 131072, 'consistent'), ('iso9660.bin', 'iso9660', 'filesystem', 0, 40960, 'consistent'), ('exfat.bin', 'exfat', 'filesystem', 0, 4096, 'consistent'),
    ('fat16.bin', 'fat', 'filesystem', 0, 2571776, 'consistent'), ('fat32.bin', 'fat32', 'filesystem', 0, 32768, 'consistent'), ('cramfs.bin', 'cramfs', 'filesystem', 0, 1384, 'consistent'), ('cramfs_be.bin', 'cramfs', 'filesystem', 0, 1384, 'consistent'),
    ('romfs.bin', 'romfs', 'filesystem', 0, 448, 'consistent'), ('image.sxv', 'sxverity', 'container', 0, 4096, 'consistent'), ('image.sxv', 'romfs', 'filesystem', 4096, 448, 'consistent'), ('jffs2.bin', 'jffs2', 'filesystem', 0, 860, 'verified'),
    ('ubi.bin', 'ubi', 'filesystem', 0, 49152, 'verified'), ('ubifs.bin', 'ubifs', 'filesystem', 0, 3160, 'verified'), ('device.dtb', 'dtb', 'dtb', 0, 72, 'consistent'), ('image.fit', 'fit', 'container', 0, 117, 'consistent'),
    ('kernel.uimage', 'uimage', 'container', 0, 93, 'verified'), ('kernel_bad.uimage', 'uimage', 'container', 0, 64, 'structural'), ('kernel_bad.uimage', 'gzip', 'compression', 64, 29, 'structural'), ('blob.gz', 'gzip', 'compression', 0, 27, 'structural'),
    ('blob.xz', 'xz', 'compression', 0, 76, 'verified'), ('blob.lz4', 'lz4', 'compression', 0, 30, 'structural'), ('blob.lz4l', 'lz4_legacy', 'compression', 0, 14, 'structural'), ('blob.zst', 'zstd', 'compression', 0, 20, 'structural'),
    ('blob.lzma', 'lzma', 'compression', 0, 295, 'verified'), ('initramfs.cpio', 'cpio', 'archive', 0, 788, 'consistent'), ('archive.tar', 'tar', 'archive', 0, 10240, 'consistent'), ('archive.7z', '7z', 'archive', 0, 32, 'structural'),
    ('archive.rar', 'rar', 'archive', 0, 32, 'structural'), ('blob.bz2', 'bzip2', 'compression', 0, 32, 'structural'), ('prog64.elf', 'elf', 'executable', 0, 200, 'consistent'), ('prog.upx', 'upx', 'compression', 64, 32, 'verified'),
    ('boot.img', 'android_boot', 'container', 0, 6144, 'consistent'), ('super.sparse', 'android_sparse', 'container', 0, 4164, 'consistent'), ('pieeprom.bin', 'rpi_eeprom', 'bootloader', 0, 32, 'structural'), ('lk.mtk', 'mtk_lk', 'bootloader', 0, 1212, 'consistent'),
    ('uboot.env', 'uboot_env', 'bootloader', 512, 4096, 'verified'), ('vbmeta.img', 'vbmeta', 'bootloader', 0, 576, 'consistent'), ('firmware.fv', 'uefi_fv', 'bootloader', 0, 4096, 'verified'), ('hashtree.verity', 'verity', 'crypto', 0, 16384, 'consistent'),
    ('firmware.hex', 'ihex', 'firmware', 0, 46, 'consistent'), ('image.png', 'png', 'image', 0, 69, 'verified'), ('image.gif', 'gif', 'image', 0, 29, 'consistent'), ('image.bmp', 'bmp', 'image', 0, 58, 'structural'), ('image.jpg', 'jpeg', 'image', 0, 46, 'consistent'),
    ('doc.pdf', 'pdf', 'document', 0, 41, 'structural'), ('archive.zip', 'zip', 'archive', 0, 224, 'consistent'), ('id_ed25519', 'private_key', 'crypto', 0, 59, 'consistent'), ('server.crt', 'certificate', 'crypto', 0, 59, 'consistent'),
    ('install.cab', 'cab', 'archive', 0, 121, 'verified'), ('fw.vbf', 'vbf', 'firmware', 0, 97, 'verified'), ('littlefs_tree.bin', 'littlefs', 'filesystem', 0, 8192, 'verified'), ('spiffs.bin', 'spiffs', 'filesystem', 0, 8192, 'consistent'),
    ('rootfs.yaffs2', 'yaffs2', 'filesystem', 0, 19008, 'structural'), ('rootfs_be.yaffs2', 'yaffs2', 'filesystem', 0, 19008, 'structural'), ('exfat_tree.bin', 'exfat', 'filesystem', 0, 36864, 'consistent'), ('installer.msi', 'cfbf', 'container', 0, 7680, 'verified'),
    ('fw.rfp', 'rae_rfp', 'firmware', 0, 127, 'verified'), ('fw.shrs', 'dlink_shrs', 'encrypted', 0, 1852, 'verified'), ('fw.encrpted_img', 'dlink_encrpted_img', 'encrypted', 0, 16400, 'verified'), ('fw.salted', 'openssl_salted', 'encrypted', 0, 2080, 'verified'),
    ('fw_unknown.salted', 'openssl_salted', 'encrypted', 0, 2080, 'structural'), ('fw.mh01', 'dlink_mh01', 'encrypted', 0, 145, 'verified'), ('fw.dlk', 'dlink_dlk', 'encrypted', 0, 752, 'verified'), ('fw.tlv', 'dlink_tlv', 'encrypted', 0, 324, 'verified'),
    ('fw.engenius', 'engenius', 'encrypted', 0, 212, 'verified'), ('fw.dlink_ota', 'dlink_ota', 'encrypted', 0, 104, 'verified'),
    ('install_lzx.cab', 'cab', 'archive', 0, 393, 'verified'), ('blob.jzlzma', 'jzlzma', 'compression', 0, 34, 'verified'), ('fw_packed.vbf', 'vbf', 'firmware', 0, 123, 'consistent'), ('fw.otra', 'otra', 'firmware', 0, 926, 'verified'), ('prog_packed.upx', 'elf', 'executable', 0, 120, 'consistent'), ('prog_packed.upx', 'upx', 'compression', 380, 32, 'verified'),
    ('tree.hfsplus', 'hfsplus', 'filesystem', 0, 51200, 'consistent'), ('tree.xfs', 'xfs', 'filesystem', 0, 32768, 'consistent'), ('tree.erofs', 'erofs', 'filesystem', 0, 16384, 'consistent'), ('tree.btrfs', 'btrfs', 'filesystem', 0, 262144, 'consistent'), ('tree.f2fs', 'f2fs', 'filesystem', 0, 163840, 'consistent'), ('default.hv', 'wince_hive', 'container', 0, 1024, 'consistent')
) AS t(sample, type_, category, offset_, size_, tier)"""


@_query(f"SELECT sample, type_, category, CAST(offset_ AS BIGINT) AS offset_, CAST(size_ AS BIGINT) AS size_, tier FROM {_IDENTIFIED}")
def identify_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every sample, the vendor set's version string aside; what is no image has none."""
    return _findings(spark).where("type_ <> 'u_boot_version_string'").select("sample", "type_", "category", "offset_", "size_", "tier")


@_query("""SELECT * FROM (VALUES ('squashfs.bin', '4.0', 'gzip', ''), ('squashfs_be.bin', '4.0', 'xz', ''), ('kernel.uimage', '', 'gzip', 'Linux'), ('luks1.bin', '1', '', 'aes-xts-plain64, sha256, 512-bit'), ('luks2.bin', '2', '', 'aes-xts-plain64'),
    ('install.cab', '1.3', 'mszip', '1 folders, 2 files'), ('blob.lzma', '', '', '10240 bytes, dict 65536 B'), ('installer.msi', '3.62', '', '1 storages, 3 streams'), ('spiffs.bin', '', '', 'page 256/block 4096'), ('lk.mtk', '', '', 'lk'), ('hashtree.verity', '', '', 'sha256'),
    ('littlefs_tree.bin', '2.1', '', ''), ('firmware.fv', '', '', '03020100-0504-0706-0809-0a0b0c0d0e0f'), ('fw.rfp', '1', 'lzari', 'IniFile'), ('fw.salted', '', 'AES-256-CBC', 'tar'), ('prog.upx', '13', 'NRV2E', 'UPX-packed ELF amd64'), ('prog_packed.upx', '3.96', 'NRV2E', 'UPX-packed ELF amd64'), ('fw.otra', '1.02.03', 'lzo1x', ''), ('fw_packed.vbf', '2.5', 'lzss', 'P-7'), ('blob.jzlzma', '', '', '300 bytes, dict 64 KiB')) AS t(sample, version, compression, label)""")
def describe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validators read out of headers."""
    named = ("squashfs.bin", "squashfs_be.bin", "kernel.uimage", "luks1.bin", "luks2.bin", "install.cab", "blob.lzma", "installer.msi", "spiffs.bin", "lk.mtk", "hashtree.verity", "littlefs_tree.bin", "firmware.fv", "fw.rfp", "fw.salted", "prog.upx", "prog_packed.upx", "fw.otra", "fw_packed.vbf", "blob.jzlzma")
    return _findings(spark, *named).where("not (sample = 'prog_packed.upx' and type_ = 'elf')").select("sample", "version", "compression", "label")


_CONF, _README, _LARGE = "repeat('a = 1\n', 20)", "repeat('hello ', 30)", "unhex(repeat(h, 50))"
_UNPACKED = f"""h256 AS (SELECT string_agg(printf('%02x', i), '' ORDER BY i) AS h, string_agg(CASE WHEN i < 240 THEN printf('%02x', i) ELSE '' END, '' ORDER BY i) AS h240, string_agg(CASE WHEN i < 250 THEN printf('%02x', i) ELSE '' END, '' ORDER BY i) AS h250 FROM range(256) t(i)),
    tree(path, kind, body) AS (VALUES ('etc/conf', 'file', encode({_CONF})), ('readme', 'file', encode({_README}))),
    flat(path, kind, body) AS (SELECT 'large', 'file', {_LARGE} FROM h256 UNION ALL SELECT 'readme', 'file', encode({_README})),
    e(sample, path, kind, body) AS (
        SELECT s, path, kind, body FROM tree, (VALUES ('archive.tar'), ('archive.zip'), ('initramfs.cpio'), ('romfs.bin'), ('image.sxv'), ('install.cab')) v(s)
        UNION ALL SELECT s, path, kind, body FROM flat, (VALUES ('squashfs.bin'), ('squashfs_be.bin'), ('cramfs.bin'), ('cramfs_be.bin')) v(s)
        UNION ALL SELECT s, 'data', 'file', encode(repeat('abc', 99)) FROM (VALUES ('blob.gz'), ('blob.xz'), ('blob.zst')) v(s)
        UNION ALL SELECT s, 'etc/conf', 'file', encode(repeat('a', 2048) || repeat('B', 2048) || repeat('c', 904)) FROM (VALUES ('rootfs.yaffs2'), ('rootfs_be.yaffs2')) v(s)
        UNION ALL SELECT 'ext.bin', 'large', 'file', unhex(repeat(h, 60)) FROM h256 UNION ALL SELECT 'blob.lzma', 'data', 'file', unhex(repeat(h, 40)) FROM h256
        UNION ALL SELECT 'littlefs_tree.bin', 'large', 'file', unhex(repeat(h, 5)) FROM h256 UNION ALL SELECT 'spiffs.bin', 'config.txt', 'file', unhex(h) || encode(repeat('tail', 20)) FROM h256
        UNION ALL SELECT 'fat16.bin', 'DATA.BIN', 'file', unhex(repeat(h240, 5)) FROM h256 UNION ALL SELECT 'exfat_tree.bin', 'a rather long name.bin', 'file', unhex(repeat(h250, 4)) FROM h256
        UNION ALL SELECT 'installer.msi', 'large', 'file', unhex(repeat(h, 17)) FROM h256
        UNION ALL SELECT s, 'etc/conf', 'file', encode({_CONF}) FROM (VALUES ('tree.hfsplus'), ('tree.xfs'), ('tree.erofs'), ('tree.btrfs'), ('tree.f2fs')) v(s) UNION ALL SELECT s, 'link', 'symlink', encode('etc/conf') FROM (VALUES ('tree.hfsplus'), ('tree.xfs'), ('tree.erofs'), ('tree.btrfs'), ('tree.f2fs')) v(s)
        UNION ALL SELECT s, 'large', 'file', unhex(repeat(h, 40)) FROM h256, (VALUES ('tree.hfsplus'), ('tree.xfs')) v(s) UNION ALL SELECT 'tree.hfsplus', 'many', 'file', unhex(repeat(h, 20)) FROM h256
        UNION ALL SELECT 'tree.xfs', 'tree', 'file', unhex(repeat(h, 4) || repeat('00', 512) || repeat(h, 2)) FROM h256 UNION ALL SELECT 'tree.erofs', 'large', 'file', unhex(repeat(h, 5) || left(h, 40)) FROM h256
        UNION ALL SELECT 'tree.f2fs', 'a name of many slots', 'file', unhex(repeat(h, 16) || repeat('00', 873 * 4096) || repeat(h, 16)) FROM h256
        UNION ALL SELECT 'tree.btrfs', 'large', 'file', unhex(repeat(h, 40) || repeat('00', 2048) || repeat('72', 4096)) FROM h256
        UNION ALL SELECT * FROM (VALUES
            ('archive.tar', 'link', 'symlink', encode('etc/conf')), ('initramfs.cpio', 'link', 'symlink', encode('readme')), ('blob.lz4', 'data', 'file', encode('abcabcabcazraw')), ('blob.lz4l', 'data', 'file', encode(repeat('a', 276))),
            ('ext.bin', 'etc/conf', 'file', encode({_CONF})), ('ext.bin', 'link', 'symlink', encode('etc/conf')), ('iso9660.bin', 'readme.txt', 'file', encode('hello')), ('iso9660.bin', 'SUB/A.BIN', 'file', encode('hel')), ('iso9660.bin', 'link', 'symlink', encode('etc')),
            ('fat16.bin', 'SUB/A long name.txt', 'file', encode('hello')), ('jffs2.bin', 'etc/conf', 'file', encode(repeat('new', 100) || repeat('z', 200))), ('jffs2.bin', 'link', 'symlink', encode('etc/conf')),
            ('ubifs.bin', 'etc/conf', 'file', encode(repeat('a', 4096) || repeat('c', 904))), ('ubifs.bin', 'link', 'symlink', encode('etc/conf')), ('ubifs.bin', 'lost+found/inode-5', 'file', encode('x')),
            ('image.fit', 'kernel-1', 'file', encode('payload')), ('kernel.uimage', 'payload', 'file', encode(repeat('kernel', 20))), ('kernel_bad.uimage', 'data', 'file', encode(repeat('kernel', 20))), ('boot.img', 'kernel', 'file', encode('kerne')), ('boot.img', 'ramdisk', 'file', encode('ram')),
            ('super.sparse', 'unsparsed.img', 'file', encode(repeat('raw!', 1024) || repeat('fill', 1024)) || unhex(repeat('00', 8192))), ('firmware.hex', '0x00000000.bin', 'file', unhex('0102030405')),
            ('uboot.env', 'environment.txt', 'file', encode('arch=arm\nbootcmd=run x\nbaudrate=115200\nbootdelay=3\nipaddr=10.0.0.1\n')), ('vbmeta.img', 'vbmeta-pubkey.bin', 'file', encode(repeat('k', 64))),
            ('fw.vbf', 'header.txt', 'file', encode('vbf_version = 2.6;\nheader {{ sw_part_number = "1"; erase = {{ {{1,2}} }}; }}')), ('fw.vbf', '0x00000000.bin', 'file', encode('abc')), ('fw.vbf', '0x00000010.bin', 'file', encode('defg')),
            ('littlefs_tree.bin', 'etc/conf', 'file', encode({_CONF})), ('littlefs_tree.bin', 'note', 'file', encode('inline')), ('rootfs.yaffs2', 'link', 'symlink', encode('etc/conf')), ('rootfs_be.yaffs2', 'link', 'symlink', encode('etc/conf')),
            ('exfat_tree.bin', 'sub/conf', 'file', encode(repeat('x', 512) || repeat('y', 88))), ('installer.msi', 'box/note', 'file', encode('hello')), ('installer.msi', 'ABC', 'file', encode('msi')),
            ('fw.rfp', 'IniFile', 'file', encode('[info]\nversion = 1\n' || repeat('=', 100))), ('fw.rfp', 'BinFile', 'file', encode('raw bytes')),
            ('esp32_nvs.bin', 'nvs-values.txt', 'file', encode('# sensitive keys: wifi:ssid\nwifi:channel = 11 ; uint32_t\nwifi:ssid = "my network" ; string\n')),
            ('fw.mh01', 'descrambled.bin', 'file', encode('MH01' || repeat('inner', 9))), ('fw.tlv', 'descrambled.bin', 'file', unhex('1f8b') || encode(repeat('stream', 30))), ('fw.engenius', 'descrambled.bin', 'file', encode('hsqs') || unhex(repeat('00', 60)) || encode('rest')),
            ('fw.dlink_ota', 'descrambled.bin', 'file', encode('81958711' || repeat('firmware', 8))), ('default.hv', 'registry-values.txt', 'file', encode('0x00000048  Name0  REG_SZ  value 0
0x0000006c  Name1  REG_DWORD  1001
0x00000086  Name2  REG_SZ  value 2
0x000000aa  Name3  REG_DWORD  1003
0x000000c4  Name4  REG_SZ  value 4
0x000000e8  Name5  REG_DWORD  1005
0x00000102  Name6  REG_SZ  value 6
0x00000126  Name7  REG_DWORD  1007
0x00000140  Raw  REG_BINARY  00ff10
')), ('install_lzx.cab', 'etc/conf', 'file', encode({_CONF})), ('install_lzx.cab', 'rest', 'file', encode(repeat('=', 100) || 'stored as it is')), ('blob.jzlzma', 'data', 'file', encode({_CONF} || {_README})),
            ('fw_packed.vbf', 'header.txt', 'file', encode('vbf_version = 2.5;\nheader {{ sw_part_number = "P-7"; data_format_identifier = 0x10; }}')), ('fw_packed.vbf', '0x00000100.bin', 'file', encode({_README})),
            ('fw.otra', '00_boot.bin', 'file', encode('boot code')), ('fw.otra', '01_root_fs.bin', 'file', encode(repeat('root ', 20) || 'more root')),
            ('prog_packed.upx', 'unpacked.elf', 'file', unhex('7f454c46020101' || repeat('00', 9) || '02003e0001000000' || repeat('00', 8) || '4000000000000000' || repeat('00', 12) || '4000380001004000' || repeat('00', 4)
                || '0100000005000000' || repeat('00', 24) || '2c01000000000000' || '2c01000000000000' || '0010000000000000' || repeat('90', 40) || 'e8ecffffff' || repeat('90', 30) || (SELECT string_agg(printf('%02x', i), '' ORDER BY i) FROM range(100) t(i)) || repeat('cc', 5)) || encode('behind the loaded part'))
        ) AS t
    )"""  # fmt: skip


@_query(f"WITH {_UNPACKED} SELECT sample, path, kind, sha256(body) AS sha256, octet_length(body) AS size FROM e")
def unpack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the samples of known contents, at the first level."""
    blobs = _samples(spark)
    rows = extract.extract(blobs, _packaged(), depth=1).where("path is not null").join(blobs.select(F.col("blob_id").alias("root_id"), "sample"), "root_id")
    spelled = ~((F.col("sample") == "vbmeta.img") & (F.col("path") == "vbmeta-descriptors.bin")) & ~F.col("sample").isin("ubi.bin", "fw.shrs", "fw.salted", "fw.encrpted_img", "fw.dlk")
    return rows.where(spelled).select("sample", "path", "kind", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


@_query("""SELECT * FROM (VALUES ('ubi.bin', 'kernel.img', 12288, 'ok'), ('ubi.bin', 'rootfs.img', 6144, 'ok'), ('fw_unknown.salted', NULL, NULL, 'error:no-key'), ('kernel_bad.uimage', NULL, NULL, 'error:truncated'), ('kernel_bad.uimage', 'data', 120, 'ok'),
    ('vbmeta.img', 'vbmeta-pubkey.bin', 64, 'ok'), ('vbmeta.img', 'vbmeta-descriptors.bin', 192, 'ok')) AS t(sample, path, size, status)""")
def unpack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, also of what can't be unpacked."""
    blobs = _samples(spark, "ubi.bin", "fw_unknown.salted", "kernel_bad.uimage", "vbmeta.img")
    rows = extract.extract(blobs, _packaged(), depth=1).join(blobs.select(F.col("blob_id").alias("root_id"), "sample"), "root_id")
    return rows.select("sample", "path", F.octet_length("content").alias("size"), "status")


def _nested(spark: SparkSession) -> DataFrame:
    """An archive in a stream in a boot image; a scrambled archive; a program that carries an archive; a stream that grows a thousandfold."""
    made = _images()
    elf = made["prog64.elf"] + made["archive.zip"]
    rows = [(1, images.uimage(images.gzip_(made["archive.tar"]))), (2, made["fw.salted"]), (3, images.gzip_(elf)), (4, images.gzip_(bytes(12 << 20)))]
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "blob_id long, content binary")


@_query("""SELECT * FROM (VALUES (1, 1, 'uimage', 'payload', 'ok', NULL), (1, 2, 'tar', 'etc/conf', 'ok', NULL), (1, 2, 'tar', 'link', 'ok', NULL), (1, 2, 'tar', 'readme', 'ok', NULL), (2, 1, 'openssl_salted', 'descrambled.bin', 'ok', NULL),
    (2, 2, 'tar', 'etc/conf', 'ok', NULL), (2, 2, 'tar', 'readme', 'ok', NULL), (3, 1, 'gzip', 'data', 'ok', NULL), (3, 2, 'elf', NULL, 'skipped:executable', NULL), (4, 1, 'gzip', 'data', 'ok', 'ratio')) AS t(root_id, depth, type_, path, status, capped)""")
def unpack_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was unpacked is unpacked again; programs and what grew beyond measure aren't."""
    rows = extract.extract(_nested(spark), _packaged())
    return rows.select(F.col("root_id").cast("int").alias("root_id"), "depth", "type_", "path", "status", "capped")


@_query("""SELECT * FROM (VALUES (1, false, NULL, 0, 2, 3), (2, false, NULL, 0, 2, 3), (3, false, NULL, 1, 2, 1), (4, true, 'ratio', 0, 1, 1)) AS t(blob_id, capped, cap_reason, skipped, entries, files)""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: read back from the documents."""
    entry = "struct<source:long,capped:boolean,cap_reason:string,skipped_nested_executables:long,entries:array<struct<depth:int,type:string,status:string,files:long>>>"
    d = F.from_json("json", entry)
    files = F.aggregate(d["entries"], F.lit(0).cast("long"), lambda s, e: s + e["files"])
    return extract.manifest(extract.extract(_nested(spark), _packaged())).select(F.col("blob_id").cast("int").alias("blob_id"), d["capped"].alias("capped"), d["cap_reason"].alias("cap_reason"), d["skipped_nested_executables"].cast("int").alias("skipped"), F.size(d["entries"]).alias("entries"), files.cast("int").alias("files"))


@_query("""SELECT * FROM (VALUES (1, 2, 'capped', 'max-files'), (2, 2, 'capped', 'max-files'), (3, 2, 'capped', 'max-files')) AS t(root_id, depth, status, capped)""")
def unpack_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-3, AGG-15: a blob at its limit of files goes no deeper, and says so."""
    rows = extract.extract(_nested(spark), _packaged(), most_files=1)
    return rows.where("status = 'capped'").select(F.col("root_id").cast("int").alias("root_id"), "depth", "status", "capped")


@_query("""SELECT * FROM (VALUES ('kernel', 6144, 'dynamic', NULL), ('rootfs', 6144, 'dynamic', 'private_key')) AS t(name, size, note, child)""")
def ubi_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-9: volumes as members, with the key that lies in one."""
    m = _findings(spark, "ubi.bin").where("type_ = 'ubi'").select(F.explode("members").alias("m"))
    return m.select("m.name", F.col("m.size").cast("int").alias("size"), "m.note", F.get("m.children", F.lit(0))["type"].alias("child"))


@_query("""SELECT * FROM (VALUES ('gpt.bin', 'rootfs', 20480, 4096), ('mbr.bin', 'p1', 2048, 4096), ('mbr.bin', 'p2', 8192, 10240), ('mbr.bin', 'p3', 8704, 3072), ('esp32_part.bin', 'nvs', 36864, 24576), ('esp32_part.bin', 'factory', 65536, 1048576)) AS t(sample, name, offset_, size_)""")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of partition tables, logical ones too."""
    m = _findings(spark, "gpt.bin", "mbr.bin", "esp32_part.bin").where("offset_ in (0, 512, 32768)").select("sample", F.explode("members").alias("m"))
    return m.select("sample", "m.name", F.col("m.offset").cast("int").alias("offset_"), F.col("m.size").cast("int").alias("size_"))


@_query("""SELECT * FROM (VALUES ('archive.tar', 'etc/conf', 120, ''), ('archive.tar', 'readme', 180, ''), ('archive.tar', 'link', 0, 'symlink'), ('archive.zip', 'etc/conf', 120, 'deflate'), ('archive.zip', 'readme', 180, 'deflate'),
    ('initramfs.cpio', 'etc/conf', 120, ''), ('initramfs.cpio', 'readme', 180, ''), ('initramfs.cpio', 'link', 6, 'symlink'), ('install.cab', 'etc/conf', 120, 'mszip'), ('install.cab', 'readme', 180, 'mszip'),
    ('installer.msi', 'box', 0, 'storage'), ('installer.msi', 'box/note', 5, 'stream'), ('installer.msi', 'large', 4352, 'stream'), ('installer.msi', 'ABC', 3, 'stream')) AS t(sample, name, size, note)""")
def list_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LST-1 to LST-5."""
    names = ("archive.tar", "archive.zip", "initramfs.cpio", "install.cab", "installer.msi")
    blobs = _samples(spark, *names)
    rows = listing.listed(blobs, identify.identify(blobs, _packaged())).join(blobs.select("blob_id", "sample"), "blob_id")
    return rows.select("sample", "name", F.col("size").cast("int").alias("size"), "note")


@_query("""SELECT * FROM (VALUES ('ubi.bin', 0, 49152, 'ubi', '0x00000000-ubi.bin'), ('uboot.env', 512, 4096, 'uboot_env', '0x00000200-uboot_env.bin'),
    ('hashtree.verity', 0, 16384, 'verity', '0x00000000-verity.bin'), ('hashtree.verity', 16384, 4096, 'unknown', '0x00004000-unknown.bin'), ('config.txt', 0, 440, 'unknown', '0x00000000-unknown.bin'),
    ('gpt.bin', 512, 92, 'gpt', '0x00000200-gpt.bin'), ('gpt.bin', 604, 50596, 'unknown', '0x0000025c-unknown.bin'), ('gpt.bin', 0, 512, 'unknown', '0x00000000-unknown.bin')) AS t(sample, offset_, size_, type_, name)""")
def carve_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: findings and unidentified ranges of 440 bytes and more; a content is its range."""
    blobs = _samples(spark, "ubi.bin", "uboot.env", "hashtree.verity", "config.txt", "gpt.bin")
    cut = sinks.carve(blobs, identify.identify(blobs, _packaged()), 440).join(blobs.select("blob_id", "sample", F.col("content").alias("whole")), "blob_id")
    same = cut.where(F.col("content") == F.expr("substring(whole, cast(offset_ + 1 as int), cast(size_ as int))"))
    return same.where("not (sample = 'uboot.env' and type_ = 'unknown')").select("sample", F.col("offset_").cast("int").alias("offset_"), F.col("size_").cast("int").alias("size_"), "type_", "name")


@_query("""SELECT * FROM (VALUES ('ubi.bin', 49152, 'ubi', 'ubi; 1 key/cert', NULL), ('image.sxv', 4544, 'sxverity, romfs', 'sxverity + romfs', NULL), ('hashtree.verity', 20480, 'verity', 'verity; 1 key/cert', 4096),
    ('mbr.bin', 20480, 'mbr x2', 'mbr', 11776), ('config.txt', 440, 'no known signatures identified', 'no known structures identified', NULL), ('empty.bin', 0, 'no known signatures identified', 'no known structures identified', NULL)) AS t(sample, size, summary, assessment, largest_gap)""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: read back from the documents."""
    blobs = _samples(spark, "ubi.bin", "image.sxv", "hashtree.verity", "mbr.bin", "config.txt", "empty.bin")
    d = F.from_json("json", "struct<size:int,summary:string,assessment:string,unidentified:array<struct<offset:int,size:int>>>")
    rows = sinks.documents(blobs, identify.identify(blobs, _packaged())).join(blobs.select("blob_id", "sample"), "blob_id")
    return rows.select("sample", d["size"].alias("size"), d["summary"].alias("summary"), d["assessment"].alias("assessment"), F.array_max(F.transform(d["unidentified"], lambda x: x["size"])).alias("largest_gap"))


@_query("""SELECT * FROM (VALUES ('kernel.uimage', 'uimage', 'info', 'uimage-payload-endian-unknown'), ('fw_unknown.salted', 'openssl_salted', 'warning', 'scheme-no-key')) AS t(sample, type_, severity, code)""")
def diagnostics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13; every diagnostic has a message."""
    names = ("kernel.uimage", "fw_unknown.salted", "archive.tar")
    rows = sinks.diagnostics(identify.identify(_samples(spark, *names), _packaged())).join(_samples(spark, *names).select("blob_id", "sample"), "blob_id")
    return rows.where("length(message) > 10").select("sample", "type_", "severity", "code")


@_query("""SELECT * FROM (VALUES ('hashtree.verity', 4096, 16384, 0.0::DOUBLE), ('blob.lzma', 0, 1, 0.0::DOUBLE)) AS t(sample, offset_, size_, entropy)""")
def finding_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5 over ranges whose entropy is known."""
    blobs = _samples(spark, "hashtree.verity", "blob.lzma")
    ranges = blobs.select("blob_id", F.when(F.col("sample") == "blob.lzma", 0).otherwise(4096).alias("offset_"), F.when(F.col("sample") == "blob.lzma", 1).otherwise(16384).alias("size_"))
    found = summaries.range_entropy(blobs, ranges).join(blobs.select("blob_id", "sample"), "blob_id")
    return found.select("sample", F.col("offset_").cast("int").alias("offset_"), F.col("size_").cast("int").alias("size_"), "entropy")


def _vectors(spark: SparkSession, rows: list[tuple], schema: str, f) -> DataFrame:
    """f of each row, in workers, as they are called elsewhere."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"name": r["name"], "result": f(r)} for r in batch.to_pylist()], schema=pa.schema([("name", pa.string()), ("result", pa.string())]))

    return spark.createDataFrame(rows, schema).mapInArrow(run, "name string, result string")


_CHECKSUMS = {"crc32": checksums.crc32, "crc32_jffs2": checksums.crc32_jffs2, "crc32_ubi": checksums.crc32_ubi, "crc32_nvs": checksums.crc32_nvs, "crc16_ccitt": checksums.crc16_ccitt}


def _checksum(row: dict) -> str:
    return f"{_CHECKSUMS[row['name']](row['data']):08x}"


@_query("SELECT * FROM (VALUES ('crc32', 'cbf43926'), ('crc32_jffs2', '2dfd2d88'), ('crc32_ubi', '340bc6d9'), ('crc32_nvs', 'd202d277'), ('crc16_ccitt', '000029b1')) AS t(name, result)")
def checksum_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1 to FN-4 of the digits 1 to 9."""
    return _vectors(spark, [(k, bytearray(b"123456789")) for k in _CHECKSUMS], "name string, data binary", _checksum)


def _rule(row: dict) -> str:
    rule, names = expr.compile_rule(row["rule"])
    return f"{rule({'x': row['x'], '_avail': 100})} {','.join(sorted(names))}".strip()


_RULES = [("precedence", "2 + 3 * 4", 0), ("shift", "1 << 4 | 1", 0), ("hexadecimal", "0x10 == 16", 0), ("in", "x in 5..7", 6), ("not in", "x in 5..7", 8), ("by zero", "1 / 0", 0), ("far shift", "1 << 99", 0), ("complement", "~0", 0), ("wraps", "0 - 1", 0), ("and", "x > 1 && x < 9", 4), ("or", "x == 1 || x == 2", 3), ("avail", "x + 8 <= _avail", 92), ("modulo", "x % 8 == 0", 24), ("group", "(x & (x - 1)) == 0", 64)]


@_query("""SELECT * FROM (VALUES ('precedence', '14'), ('shift', '17'), ('hexadecimal', '1'), ('in', '1 x'), ('not in', '0 x'), ('by zero', '0'), ('far shift', '0'), ('complement', '18446744073709551615'), ('wraps', '18446744073709551615'),
    ('and', '1 x'), ('or', '0 x'), ('avail', '1 _avail,x'), ('modulo', '1 x'), ('group', '1 x')) AS t(name, result)""")
def rule_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-1 to FIL-4: value and variables of rules."""
    return _vectors(spark, _RULES, "name string, rule string, x long", _rule)


def _rule_rows(batches, sources: tuple[str, ...], size: str):
    rules, size_of = [expr.compile_rule(s)[0] for s in sources], expr.compile_rule(size)[0]
    for batch in batches:
        out = [{"l_orderkey": r["k"], "bytes": min(size_of(r), r["_avail"])} for r in batch.to_pylist() if all(rule(r) for rule in rules)]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("l_orderkey", pa.int64()), ("bytes", pa.int64())]))


@_query("""SELECT l_orderkey, count(*) AS kept, CAST(sum(least(l_quantity * 100, 3000)) AS BIGINT) AS bytes FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND CAST(l_partkey AS BIGINT) & 3 <> 0 AND (l_suppkey << 2) % 3 <> 1 GROUP BY l_orderkey""")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-5, FIL-7: compiled rules of the signatures' language over rows, and a size clamped to what is there."""
    rows = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.lit(3000).cast("long").alias("_avail"))
    kept = rows.mapInArrow(partial(_rule_rows, sources=("q in 5..45", "(p & 3) != 0", "(s << 2) % 3 != 1"), size="q * 100"), "l_orderkey long, bytes long")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"), F.sum("bytes").alias("bytes"))


_BANANA = b"banana " + b"n" * 50


def _codec(row: dict) -> str:
    name, data = row["name"], bytes(row["data"])
    if name.startswith("lzo"):
        return lzo.decompress(data, 99).hex()
    if name == "lzari":
        return lzari.decompress(data, 1 << 16).hex()
    if name.startswith("lz4"):
        return extract.lz4_block(data).hex()
    if name.startswith("nrv"):
        return codecs.nrv(int(name[3:]), data, 57).hex()
    if name == "jzlzma":
        return codecs.jzlzma(data, 57).hex()
    if name == "lzss":
        return codecs.lzss(data, 999).hex()
    if name.startswith("filter"):
        return codecs.unfilter(data, int(name[7:], 16), 0x77).hex()
    return containers.rtime(data, 7).hex()


@_query("""SELECT name, hex FROM (SELECT name, lower(hex(encode(body))) AS hex FROM (VALUES ('lzo literals', 'abc'), ('lzo match', 'abcdefghabcd'), ('lz4 overlap', 'abcabcabcaz'), ('rtime', 'abababa'), ('lzari', 'banana ' || repeat('n', 50)), ('jzlzma', 'banana ' || repeat('n', 50)), ('lzss', 'banana ' || repeat('n', 50)),
    ('nrv2', 'banana ' || repeat('n', 50)), ('nrv3', 'banana ' || repeat('n', 50)), ('nrv4', 'banana ' || repeat('n', 50)), ('nrv5', 'banana ' || repeat('n', 50)), ('nrv6', 'banana ' || repeat('n', 50)), ('nrv7', 'banana ' || repeat('n', 50)),
    ('nrv8', 'banana ' || repeat('n', 50)), ('nrv9', 'banana ' || repeat('n', 50)), ('nrv10', 'banana ' || repeat('n', 50))) t(name, body)
    UNION ALL SELECT * FROM (VALUES ('filter 26', '9090e81000000090909090909090'), ('filter 50', '000000eb000000eb0100000000000000'), ('filter 52', '0000009400000094000000000000000000'), ('filter 00', 'e877000000')) t(name, hex))""".replace("name, hex FROM (SELECT", "name, hex AS result FROM (SELECT"))
def codec_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD-5, COD-10 to COD-13, COD-15 to COD-17 on hand-made streams."""
    end = b"\x11\0\0"
    rows = [
        ("lzo literals", b"\x14abc" + end), ("lzo match", bytes([17 + 8]) + b"abcdefgh" + bytes([0b01111100, 0]) + end), ("lz4 overlap", bytes([0x33]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z"),
        ("rtime", bytes([97, 0, 98, 0, 97, 4])), ("lzari", stores.lzari_pack(_BANANA)), ("jzlzma", packs.jzlzma_pack(_BANANA)), ("lzss", packs.lzss_pack(_BANANA)),
        *((f"nrv{k}", packs.nrv_pack(k, _BANANA)) for k in range(2, 11)),
        ("filter 26", bytes.fromhex("9090e87700001390909090909090")), ("filter 50", bytes.fromhex("000000eb010000eb0100000000000000")), ("filter 52", bytes.fromhex("0000009401000094000000000000000000")), ("filter 00", bytes.fromhex("e877000000")),
    ]
    return _vectors(spark, [(k, bytearray(v)) for k, v in rows], "name string, data binary", _codec)


def _cipher(row: dict) -> str:
    key, iv, data = bytes(row["key"]), bytes(row["iv"]), bytes(row["data"])
    if row["name"].startswith("aes"):
        return ciphers.decrypt(data, key, iv).hex()
    if row["name"].startswith("key"):
        return b" ".join(ciphers.bytes_to_key(key, iv, row["name"].split()[1], 16, 16)).hex()
    return ciphers.hmac_sha1(key, data).hex()


@_query("""SELECT * FROM (VALUES ('aes-128', '6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51'), ('aes-256', '6bc1bee22e409f96e93d7e117393172a'), ('hmac', 'de7c9b85b8b78aa6bc8a7a36f70a90701c9db4d9')) AS t(name, result)
    UNION ALL SELECT 'key md5', md5('passwordsaltsalt') || '20' || md5(unhex(md5('passwordsaltsalt')) || encode('passwordsaltsalt'))""")
def cipher_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5 to FN-7: published vectors of the ciphers."""
    h = bytes.fromhex
    rows = [
        ("aes-128", h("2b7e151628aed2a6abf7158809cf4f3c"), h("000102030405060708090a0b0c0d0e0f"), h("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")),
        ("aes-256", h("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"), h("000102030405060708090a0b0c0d0e0f"), h("f58c4c04d6e5f1ba779eabfb5f7bfbd6")),
        ("hmac", b"key", b"", b"The quick brown fox jumps over the lazy dog"), ("key md5", b"password", b"saltsalt", b""),
    ]
    return _vectors(spark, [(a, bytearray(b), bytearray(c), bytearray(d)) for a, b, c, d in rows], "name string, key binary, iv binary, data binary", _cipher)


_TOML = [
    '[[signature]]\nname = "one"\nmagic = [{ hex = "0102" }]\nvalidator = "tar"\n[[signature]]\nname = "bad rule"\nmagic = [{ ascii = "x" }]\nconstraints = ["nothing > 1"]',
    'name = "two"\ncategory = "c"\nmagic = [{ ascii = "AB", endian = "big" }]\nstruct = "u16 a; i8 s"\nconstraints = ["a > 1"]\nsize = "a + 2"\n[doc]\ndescription = "the second"\nvendor = "nobody"\nlimitations = ["none", "known"]\n[[doc.reference]]\ntitle = "t"\nurl = "u"',
    'name = "no magic"',
    "not = [toml",
]
_VENDOR = '[[signature]]\nname = "bare"\nmagic = [{ hex = "0102" }]\n[[signature]]\nname = "both"\nmagic = [{ hex = "0102" }, { hex = "0304" }]\n[[signature]]\nname = "ruled"\nmagic = [{ hex = "0102" }]\nstruct = "u16 a"\nconstraints = ["a > 1"]'


@_query("""SELECT * FROM (VALUES ('one', 'generic', 25, '', 0), ('two', 'c', 60, 'the second nobody none,known t:u', 0), ('both', 'generic', 25, '', 1), ('ruled', 'generic', 60, '', 1), ('3 messages', '', 0, '', 0)) AS t(name, category, tier, about, priority)""")
def signature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 to SRC-8: documents with one or several signatures, what is left out of them, and the second set without what the first claims."""
    first = [catalog.load_text(t, f"{k}.toml") for k, t in enumerate(_TOML)]
    kept = catalog.without_redundant([s for found, _ in first for s in found] + catalog.load_text(_VENDOR, priority=1)[0])
    rows = [(s.name, s.category, s.tier, " ".join(x for x in (s.description, s.vendor, ",".join(s.limitations), ",".join(":".join(r) for r in s.references)) if x), s.priority) for s in kept]
    return spark.createDataFrame([*rows, (f"{sum(len(bad) for _, bad in first)} messages", "", 0, "", 0)], "name string, category string, tier int, about string, priority int")


def _read_layout(row: dict) -> str:
    found = layout.parse("u32 a; u16 b; bytes[4] c; u8 d; i8 s").read(bytes(row["data"]), 0, "little")
    return "none" if found is None else " ".join(f"{k}={v}" for k, v in sorted(found.items()))


@_query("SELECT * FROM (VALUES ('whole', 'a=67305985 b=1541 d=12 s=18446744073709551615'), ('short', 'none')) AS t(name, result)")
def layout_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1 to PRJ-3: runs of bytes are no fields, signs are extended to 64 bits, a short header is none."""
    rows = [("whole", bytearray([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 255])), ("short", bytearray(11))]
    return _vectors(spark, rows, "name string, data binary", _read_layout)


def _path(row: dict) -> str:
    try:
        return extract.safe_path(row["path"])
    except extract.Stop as e:
        return str(e)


@_query("SELECT * FROM (VALUES ('plain', 'a/b'), ('dots', 'a/b'), ('root', 'etc/x'), ('up', 'error:unsafe-path'), ('back', 'a/b'), ('empty', 'error:unsafe-path')) AS t(name, result)")
def path_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19."""
    rows = [("plain", "a/b"), ("dots", "./a//./b"), ("root", "/etc/x"), ("up", "a/../../x"), ("back", "a\\b"), ("empty", "/")]
    return _vectors(spark, rows, "name string, path string", _path)


@_query("SELECT * FROM (VALUES ('sta.pswd', 'true'), ('ap.authmode', 'false'), ('API_TOKEN', 'true'), ('hostname', 'false'), ('priv_data', 'true'), ('keyboard', 'true')) AS t(name, result)")
def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-20."""
    return _vectors(spark, [(k,) for k in ("sta.pswd", "ap.authmode", "API_TOKEN", "hostname", "priv_data", "keyboard")], "name string", lambda r: str(embedded.is_sensitive(r["name"])).lower())


@_query("""SELECT * FROM (VALUES ('a', '[warn: sensitive-key ×3] [info: crc] [err: bad]'), ('b', '[info: other-note]')) AS t(name, tags)""")
def diagnostic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: equal tags with their number, without their type before them."""
    d = lambda severity, code: (severity, code, "m")
    many = [d("warning", "nvs-sensitive-key"), d("info", "nvs-crc"), d("warning", "nvs-sensitive-key"), d("error", "bad"), d("warning", "nvs-sensitive-key")]
    rows = [(1, 0, "nvs", many), (2, 0, "tar", [d("info", "other-note")])]
    found = spark.createDataFrame(rows, "blob_id long, offset_ long, type_ string, diagnostics array<struct<severity:string,code:string,message:string>>")
    return reports.tags(found).select(F.when(F.col("blob_id") == 1, "a").otherwise("b").alias("name"), "tags")


@_query("""SELECT * FROM (VALUES ('image.sxv', 0, '0x00000000  4.0 KiB  sxverity  consistent'), ('image.sxv', 1, '0x00001000  448 B  romfs  consistent'), ('kernel.uimage', 0, '0x00000000  93 B  uimage  verified  "Linux"  [info: payload-endian-unknown]')) AS t(sample, nth, line)""")
def findings_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3."""
    blobs = _samples(spark, "image.sxv", "kernel.uimage")
    first = F.row_number().over(reports.Window.partitionBy("blob_id").orderBy("nth")) - 1
    return reports.tree(identify.identify(blobs, _packaged())).withColumn("nth", first).join(blobs.select("blob_id", "sample"), "blob_id").select("sample", "nth", "line")


@_query(f"""WITH n AS (SELECT l_orderkey AS path, l_linenumber AS offset_, l_shipmode AS type_ FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 't' || l_partkey % 7 AS l_shipmode FROM lineitem WHERE l_suppkey % 6 IN (0, 1, 3, 5)) x),
    p AS (SELECT printf('%09d', path) AS path, offset_, type_ FROM n)
    SELECT * FROM (SELECT * FROM p ORDER BY path, offset_, type_ LIMIT {reports.SHOWN}) UNION ALL SELECT NULL, NULL, '… and ' || (SELECT count(*) - {reports.SHOWN} FROM p) || ' more'""")
def notable_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-2 over an order's lines, as paths by number."""
    rows = tables.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS blob_id", "CAST(l_linenumber AS BIGINT) AS offset_", "concat('t', l_partkey % 7) AS type_", "CASE WHEN l_suppkey % 6 IN (0, 1, 3, 5) THEN 'crypto' ELSE 'image' END AS category")
    blobs = tables.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS blob_id", "lpad(CAST(o_orderkey AS STRING), 9, '0') AS path")
    return reports.notable(blobs, rows)


@_query("""SELECT * FROM (VALUES ('schema_version', '1'), ('root', 'samples'), ('file_count', '4'), ('files', '4'), ('assessment', '4 files: 1 gzip, 1 private_key, 1 tar; 1 key/cert'), ('by_type', 'gzip=1 private_key=1 tar=1 unknown=1'), ('notable', 'id_ed25519:private_key')) AS t(name, result)""")
def tree_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: the whole document, put together and read back."""
    blobs = _samples(spark, "archive.tar", "blob.gz", "id_ed25519", "config.txt").withColumnRenamed("sample", "path")
    rows = reports.tree_json(blobs, identify.identify(blobs, _packaged()), "samples")
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "path", "json"))), lambda x: x["json"]), "\n").alias("json"))
    d = F.from_json("json", "struct<schema_version:string,root:string,files:array<struct<path:string>>,file_count:string,assessment:string,by_type:map<string,long>,notable:array<struct<path:string,type:string>>>")
    types = F.array_join(F.transform(F.array_sort(F.map_entries(d["by_type"])), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    noted = F.array_join(F.transform(d["notable"], lambda e: F.concat(e["path"], F.lit(":"), e["type"])), " ")
    found = {"schema_version": d["schema_version"], "root": d["root"], "file_count": d["file_count"], "files": F.size(d["files"]).cast("string"), "assessment": d["assessment"], "by_type": types, "notable": noted}
    return text.select(F.explode(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)])).alias("name", "result"))


@_query("""SELECT * FROM (VALUES (1, 1, '0x00000000-uimage: 1 files, 10.0 KiB'), (1, 2, '  0x00000000-tar: 2 files, 308 B'), (3, 1, '0x00000000-gzip: 1 files, 424 B'), (3, 2, '  0x00000000-elf: skipped:executable')) AS t(root_id, depth, line)""")
def extraction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4."""
    rows = reports.extraction_tree(extract.extract(_nested(spark).where("blob_id in (1, 3)"), _packaged()))
    return rows.select(F.col("root_id").cast("int").alias("root_id"), "depth", "line")


@_query("""SELECT * FROM (VALUES (0, '0 B'), (1023, '1023 B'), (1024, '1.0 KiB'), (1600, '1.6 KiB'), (1048576, '1.0 MiB'), (3758096384, '3.5 GiB')) AS t(size, human)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-17."""
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1600, 1 << 20, 7 << 29)], "size long")
    return rows.select("size", human_size(F.col("size")).alias("human"))


def _field(row: dict) -> str:
    name, data = row["name"], bytes(row["data"])
    try:
        if name.startswith("octal"):
            return str(validators._octal(data))
        if name.startswith("pow2"):
            return str(validators._pow2(int(data))).lower()
        f = identify.Finding(0, 0, "x", "c", 60, "little")
        fields = {"header_length": 56} if name == "guid" else {}
        validators.KNOWN["uefi_fv" if name == "guid" else "mtk_lk"](data, f, fields | {"size": 1})
        return f.label
    except ValueError:
        return "none"


@_query("""SELECT * FROM (VALUES ('octal', '420'), ('octal spaces', '8'), ('octal empty', 'none'), ('octal nine', 'none'), ('pow2 4096', 'true'), ('pow2 0', 'false'), ('pow2 12', 'false'), ('guid', '03020100-0504-0706-0809-0a0b0c0d0e0f'), ('ends with zero', 'lk')) AS t(name, result)""")
def field_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12 to FN-15: octal fields, powers of two, identifiers of mixed byte order, texts that end with a zero."""
    rows = [("octal", b"0000644\0"), ("octal spaces", b"    10 \0"), ("octal empty", b"\0" * 8), ("octal nine", b"0000649\0"), ("pow2 4096", b"4096"), ("pow2 0", b"0"), ("pow2 12", b"12"), ("guid", images.uefi_fv()), ("ends with zero", images.mtk_lk())]
    return _vectors(spark, [(k, bytearray(v)) for k, v in rows], "name string, data binary", _field)


@_query("""SELECT * FROM (VALUES ('plain', 'abc'), ('quotes', 'a\\"b\\\\c'), ('control', '\\n\\t\\u0001\\u001f'), ('latin', 'caf\\u00e9\\u00ff\\u007f')) AS t(name, result)""")
def json_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11."""
    rows = [("plain", "abc"), ("quotes", 'a"b\\c'), ("control", "\n\t\x01\x1f"), ("latin", "caf\xe9\xff\x7f")]
    return spark.createDataFrame(rows, "name string, text string").select("name", json_escape(F.col("text")).alias("result"))


@_query("""SELECT o_orderkey AS blob_id, CAST(CASE WHEN o_custkey % 256 > 127 THEN o_custkey % 256 - 256 ELSE o_custkey % 256 END AS BIGINT) AS low_byte,
    CAST(CASE WHEN o_orderkey % 65536 > 32767 THEN o_orderkey % 65536 - 65536 ELSE o_orderkey % 65536 END AS BIGINT) AS low_half FROM orders""")
def layout_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3: signed integers out of packed headers."""
    c = F.col("content")
    return blobs.packed_orders(spark, sf_dir).select("blob_id", layout.column(c, 11, 1, "big", True).alias("low_byte"), layout.column(c, 18, 2, "big", True).alias("low_half"))


def _rescue() -> tuple[bytes, bytes]:
    """A disk with a stale file system over a partition that begins with another one, without and with the partition table."""
    size = 1 << 20
    ext = lambda: struct.pack("<II", 64, 256).ljust(20, b"\0") + struct.pack("<II", 1, 0) + bytes(28) + b"\x53\xef\1\0"
    plain = {0x8000 + 1024: ext(), 0x40000 + 1024: ext()}
    table = bytearray(128 * 128)
    for k, (first, last) in enumerate(((0x10000, 0x3FFFF), (0x40000, 0x7FFFF))):
        table[128 * k : 128 * k + 48] = bytes(range(1, 33)) + struct.pack("<QQ", first // 512, last // 512)
    head = b"EFI PART" + struct.pack("<IIIIQQQQ16sQIII", 0x10000, 92, 0, 0, 1, size // 512 - 1, 34, size // 512 - 34, bytes(16), 2, 128, 128, zlib.crc32(bytes(table)))
    head = head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:]
    return images.put(size, plain), images.put(size, plain | {512: head, 1024: bytes(table)})


@_query("""SELECT * FROM (VALUES ('stale', 'ext', 32768), ('table', 'gpt', 512), ('table', 'ext', 32768), ('table', 'ext', 262144), ('inside', 'uimage', 100), ('inside', 'gzip', 300)) AS t(name, type_, offset_)""")
def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAT-3, MAT-6, JOI-7: blobs of three bytes have no findings, matches inside a sure finding aren't looked at, but for those at a partition's start."""
    stale, table = _rescue()
    inside = bytes(100) + images.uimage() + bytes(107) + images.gzip_()
    rows = [(1, "stale", stale), (2, "table", table), (3, "inside", inside), (4, "short", b"\x1f\x8b\x08")]
    made = spark.createDataFrame([(k, n, bytearray(d)) for k, n, d in rows], "blob_id long, name string, content binary")
    found = identify.identify(made, _packaged(), all_=True).join(made.select("blob_id", "name"), "blob_id")
    return found.select("name", "type_", F.col("offset_").cast("int").alias("offset_"))


@_query("""SELECT * FROM (VALUES ('same place', 'b', 'a'), ('inside', 'outer', 'inner')) AS t(name, type_, also)""")
def also_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT-4: who lost to whom, by type."""
    f = lambda offset, size, confidence, type_: identify.Finding(offset, size, type_, "c", confidence, "little")
    rows = []
    for name, found in (("same place", [f(0, 100, 60, "a"), f(0, 100, 99, "b")]), ("inside", [f(0, 100, 85, "outer"), f(50, 10, 60, "inner")])):
        rows += [(name, x.type, ",".join(g.type for g in x.also)) for x in identify.resolve(found, 1000)]
    return spark.createDataFrame(rows, "name string, type_ string, also string")
