"""Packages: split runs, hidden parts, images, bundles that are all or nothing, and faults."""

import io
import json
import os
import stat
import struct
import zipfile
import zlib

import pytest

from cloakwork.cli import main
from cloakwork.plans import bundle
from cloakwork.sources import ooxml, store
from cloakwork.sources.annotations import Settings, settings_from, settings_of
from cloakwork.sources.store import MappingDecryptionError, MappingKey

W = ooxml.WORD[1:-1]
CONFIG = {"config_version": "1", "model_version": "rules-1", "deny_lists": {"IN_DIN": ["87654321"], "IN_PAN": "no list"}}


def texts(package):
    return [u[2] for u in ooxml.units_of(package)]


def part(package, name):
    return zipfile.ZipFile(io.BytesIO(package)).read(name).decode()


def white_png(width, height):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + b"\xff" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_split_runs():
    assert ooxml.patched(["Contact ", "Alice ", "Example", " today."], [(8, 21, "Bob")]) == ["Contact ", "Bob", "", " today."]
    assert ooxml.patched(["ab", "cd"], [(0, 1, "X"), (3, 4, "YY")]) == ["Xb", "cYY"]
    assert ooxml.patched(["abc"], [(1, 2, "")]) == ["ac"]
    with pytest.raises(ValueError):
        ooxml.patched(["ab"], [(5, 6, "x")])


def test_nearest_paragraph_owns_a_node():
    xml = f'<w:d xmlns:w="{W}"><w:p><w:t>out</w:t><w:x><w:p><w:t>in</w:t></w:p></w:x><w:t>er</w:t></w:p></w:d>'
    units = [[n.text for n in nodes] for _, nodes in ooxml.paragraphs(ooxml.parse(xml.encode()))]
    assert units == [["out", "er"], ["in"]]


def test_hidden_parts_are_scrubbed():
    extra = {
        "word/comments.xml": f'<w:comments xmlns:w="{W}"><w:comment w:author="Eve" w:initials="E"><w:p><w:del><w:r w:rsidDel="1"><w:delText>gone</w:delText></w:r></w:del></w:p></w:comment></w:comments>'.encode(),
        "docProps/core.xml": b'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Eve</dc:creator><dc:title>kept</dc:title></c>',
        "docProps/custom.xml": b"<p/>",
        "word/_rels/document.xml.rels": b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Type="x/hyperlink" Target="mailto:eve@example.com" TargetMode="External"/><Relationship Id="2" Type="x/custom-properties" Target="docProps/custom.xml"/></Relationships>',
    }
    out = ooxml.rewritten(ooxml.package_from([["x"]], extra), {})
    assert "docProps/custom.xml" not in zipfile.ZipFile(io.BytesIO(out)).namelist()
    comments = part(out, "word/comments.xml")
    assert "Eve" not in comments and "rsid" not in comments and "gone" in comments and "w:delText" in comments
    core = part(out, "docProps/core.xml")
    assert "Eve" not in core and "kept" in core
    rels = part(out, "word/_rels/document.xml.rels")
    assert "mailto" not in rels and "custom" not in rels and ooxml.SAFE_TARGET in rels
    assert ooxml.package_fault(out) is None and ooxml.package_fault(b"no zip") and ooxml.package_fault(out[:-30])


def test_entities_and_unknown_images_are_refused():
    with pytest.raises(ValueError):
        ooxml.parse(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')
    with pytest.raises(ValueError):
        ooxml.neutral_image(b"GIF89a")


def test_images_keep_their_size():
    for make in (ooxml.grey_png, ooxml.grey_jpeg):
        for size in ((1, 1), (2, 3), (33, 17), (200, 90)):
            neutral = ooxml.neutral_image(make(*size))
            assert ooxml.image_size(neutral)[1:] == size
    assert zlib.decompress(ooxml.grey_png(5, 4)[41:-16][:0] or zlib.compress(b"x")) == b"x"


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    runs = [["Contact Email: ", "alice.w", "@example.com", " today."], ["Write ALICE.W@example.com, case 87654321."], ["plain"]]
    (folder / "in.docx").write_bytes(ooxml.package_from(runs, {"word/media/i.png": white_png(4, 5)}))
    (folder / "config.json").write_text(json.dumps(CONFIG))
    (folder / "key").write_text(MappingKey.generate().text + "\n")
    return folder


def arguments(folder, out, **changes):
    given = {"--input": folder / "in.docx", "--output-dir": out, "--config": folder / "config.json", "--seed": "17", "--key-file": folder / "key"} | changes
    return ["redact", *[str(x) for pair in given.items() for x in pair]]


def test_bundle(spark, source, tmp_path):
    before = (source / "in.docx").read_bytes()
    assert main(arguments(source, tmp_path / "out"), {}, make_session=lambda: spark) == 0
    assert (source / "in.docx").read_bytes() == before and sorted(os.listdir(tmp_path)) == ["out"]
    out = (tmp_path / "out" / bundle.DOCUMENT).read_bytes()
    joined = "\n".join(texts(out)).lower()
    assert "alice" not in joined and "87654321" not in joined and "plain" in joined and joined.count("@example.invalid") == 2
    audit = json.loads((tmp_path / "out" / bundle.AUDIT).read_text())
    assert audit["entity_counts"] == {"EMAIL_ADDRESS": 2, "IN_DIN": 1} and audit["unique_mappings"] == 2
    assert audit["warnings"] == ["embedded_images_replaced_without_ocr", "visual_render_required_before_delivery"]
    sealed = tmp_path / "out" / bundle.MAPPING
    assert stat.S_IMODE(sealed.stat().st_mode) == 0o600 and "alice" not in sealed.read_text().lower()
    key = MappingKey.from_file(str(source / "key"))
    rows = store.read_mappings(store.load(spark, str(sealed), key)).collect()
    assert {(r["entity_type"], r["occurrences"]) for r in rows} == {("EMAIL_ADDRESS", 2), ("IN_DIN", 1)}
    with pytest.raises(MappingDecryptionError):
        store.load(spark, str(sealed), MappingKey.generate())


@pytest.mark.parametrize(
    "changes", [{"--input": "/none.docx"}, {"--config": "/none.json"}, {"--key-file": "/none"}, {"--output-dir": "/"}], ids=str
)
def test_failures_publish_nothing_and_tell_nothing(source, tmp_path, changes):
    errors = io.StringIO()
    assert main(arguments(source, tmp_path / "out", **changes), {}, errors, make_session=lambda: None) == 1
    assert not os.listdir(tmp_path) and errors.getvalue().startswith("cloakwork: redact failed (") and "none" not in errors.getvalue()


def test_publishing_is_atomic(tmp_path):
    def broken(a, b):
        raise OSError("no")

    with pytest.raises(OSError), bundle.staged(tmp_path / "out", broken) as stage:
        (stage / "a").write_text("x")
    with pytest.raises(KeyError), bundle.staged(tmp_path / "out") as stage:
        (stage / "a").write_text("x")
        raise KeyError
    assert os.listdir(tmp_path) == []
    for _ in range(1):
        with bundle.staged(tmp_path / "out") as stage:
            (stage / "a").write_text("x")
    with pytest.raises(FileExistsError), bundle.staged(tmp_path / "out"):
        pass
    assert os.listdir(tmp_path) == ["out"] and (tmp_path / "out" / "a").read_text() == "x"


def test_config_and_key(tmp_path):
    (tmp_path / "c").write_text(json.dumps(CONFIG))
    assert settings_from(tmp_path / "c").deny_lists == {"IN_DIN": ("87654321",)}
    for wrong in ([], {"deny_lists": []}, {"config_version": "1"}, CONFIG | {"deny_lists": []}, CONFIG | {"model_version": ""}):
        with pytest.raises(ValueError):
            settings_of(wrong)
    with pytest.raises(ValueError):
        bundle.check_settings(Settings("2", "rules-1"))
    with pytest.raises(ValueError):
        MappingKey.from_environment({})
    with pytest.raises(ValueError):
        MappingKey("short")
    assert "..." in repr(MappingKey.generate())
