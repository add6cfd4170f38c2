"""The closed set of variables that expressions may name, their types and their zero values.

Files lack most attributes; in an expression a missing one reads as its type's
zero, while sorts and groupings see that it is absent.  Flags that follow from
the content type are compiled to tests of that column, which Spark can push
into scans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The variable names by type.
STRINGS = """
name path dir ext content_type yaml_kind project_type plist_format plist_root_kind plist_kind plist_bundle_identifier
plist_bundle_name plist_bundle_version plist_bundle_short_version plist_executable plist_min_os_version plist_label
plist_program disk_image_format disk_type volume_label package_format package_name package_version package_release
package_arch package_kind license_id target_path bytecode_format runtime_version class_name super_class python_version
database_format browser_vendor bookmark_profile chat_channel chat_workspace font_format font_outline_kind font_family
font_subfamily font_full_name font_version font_postscript_name font_manufacturer font_designer font_license
font_license_url font_typographic_family font_embedding font_panose raw_kind raw_vendor live_photo_video_path
live_photo_image_path ocr_language ocr_provider phash model3d_format quarantine_agent quarantine_event_id
quarantine_source_url quarantine_referrer_url finder_color sqlite_wal_byte_order sqlite_text_encoding
sqlite_application_name sqlite_schema_fingerprint cdf_version cdf_encoding cdf_majority pds_version mission_name
spacecraft_name instrument_name target_name product_id start_time science_format votable_version votable_data_format
telescope instrument object observer date_obs filter fits_kind module go_version base_image title body language author
root_element json_kind c2pa_claim_generator c2pa_title c2pa_format c2pa_signed_by c2pa_verified_signer
c2pa_validation_status camera_make camera_model lens artist album album_artist composer genre video_codec audio_codec
color_primaries color_transfer binary_format binary_type codesign_identifier codesign_team_id codesign_hash_type
email_message_id email_in_reply_to kernel frontmatter_format md5 sha1 sha256 magic_content_type extension_content_type
git_last_commit_author git_last_commit_subject
"""
INTS = """
size yaml_document_count virtual_size cluster_bits image_count appimage_version method_count field_count wasm_version
section_count import_count export_count bookmark_count bookmark_folder_count chat_message_count font_weight font_width
font_units_per_em font_glyph_count font_axis_count font_collection_count woff2_total_sfnt_size
woff2_total_compressed_size live_photo_video_size vertex_count face_count xattr_count sqlite_wal_format_version
sqlite_wal_page_size sqlite_wal_checkpoint_seq sqlite_wal_frame_count sqlite_page_size sqlite_format_version
sqlite_page_count sqlite_schema_version sqlite_user_version sqlite_application_id sqlite_table_count sqlite_view_count
sqlite_index_count sqlite_trigger_count sqlite_fts_table_count variable_count attribute_count hdf5_format_version
hdf5_size_of_offsets hdf5_size_of_lengths table_count total_rows bitpix naxis naxis1 naxis2 hdu_count word_count
line_count column_count page_count img_width img_height orientation iso year track bitrate sample_rate channels
bit_depth video_width video_height rotation nominal_bitrate entry_count uncompressed_size bitness entry_point
attachment_count email_count loc comment_loc blank_loc max_complexity cell_count code_cell_count markdown_cell_count
git_commit_count
"""
DOUBLES = """
font_revision font_italic_angle ocr_confidence exptime airmass ra dec gps_lat gps_lon focal_length f_stop exposure_time
duration frame_rate replaygain_track_gain replaygain_album_gain similarity bm25
"""
TIMES = """
disk_image_created_at source_mtime chat_start_at chat_end_at quarantine_download_date c2pa_signed_at
c2pa_verified_signed_at taken_at sent_at date created_at metadata_changed_at mod_time git_last_commit_time git_first_seen
"""
LISTS = """
project_types plist_program_arguments interfaces access_flags bookmark_folders bookmark_urls bookmark_titles
chat_participants font_unicode_ranges font_mac_style font_axes font_collection_families materials xattr_keys finder_tags
sqlite_table_names sqlite_fts_table_names field_names field_units field_ucds csv_columns subtitle_languages
top_level_entries architectures entitlements email_to email_cc functions type_names imports references tags categories
"""
BOOLS = """
plist_run_at_load plist_keep_alive is_encrypted is_test_file is_generated_code is_symlink is_broken_symlink
is_variable_font is_color_font is_monospace_font is_italic_font is_bold_font is_live_photo is_live_photo_video
has_normals has_textures is_xattr_rich is_quarantined quarantine_user_approved has_finder_comment is_c2pa
c2pa_ai_generated c2pa_valid is_hdr subtitles has_root_dir is_dynamically_linked is_stripped is_codesigned
is_apple_signed is_third_party_signed codesign_hardened_runtime codesign_library_validation codesign_killed
codesign_adhoc entitlement_app_sandbox entitlement_full_disk_access entitlement_network_client
entitlement_network_server draft is_btime_anomaly is_disguised is_known_good is_known_bad is_git_tracked is_git_ignored
is_static_site
"""
# Flags that are a test of the content type: of a beginning (ends in *), or of one of several names.
FLAGS = {
    "is_image": "image/*",
    "is_office": "office/*",
    "is_audio": "audio/*",
    "is_video": "video/*",
    "is_archive": "archive/*",
    "is_binary": "binary/*",
    "is_email": "email/*",
    "is_source": "source/*",
    "is_notebook": "notebook/*",
    "is_build": "build/*",
    "is_repo_meta": "repo/*",
    "is_ignore": "ignore/*",
    "is_manifest": "manifest/*",
    "is_platform": "platform/*",
    "is_windows_metadata": "system/windows-*",
    "is_linux_metadata": "system/linux-*",
    "is_system_metadata": "system/*",
    "is_disk_image": "disk-image/*",
    "is_install_package": "install/*",
    "is_bytecode": "bytecode/*",
    "is_science_data": "science/*",
    "is_bookmark_file": "browser/bookmarks-*",
    "is_chat_export": "chat/*",
    "is_font": "font/*",
    "is_raw_photo": "image/raw-*",
    "is_3d_model": "model3d/*",
    "is_macos_metadata": "system/macos-*,system/plist",
    "is_markdown": "markdown",
    "is_json": "json,manifest/node",
    "is_yaml": "yaml",
    "is_toml": "toml,manifest/cargo",
    "is_xml": "xml",
    "is_html": "html",
    "is_pdf": "pdf",
    "is_text": "text,repo/license,repo/changelog,repo/contributing,manifest/python-reqs",
    "is_csv": "csv",
    "is_epub": "epub",
    "is_dockerfile": "build/dockerfile",
    "is_makefile": "build/makefile",
    "is_justfile": "build/justfile",
    "is_rakefile": "build/rakefile",
    "is_license": "repo/license",
    "is_changelog": "repo/changelog",
    "is_contributing": "repo/contributing",
    "is_codeowners": "repo/codeowners",
    "is_gitignore": "ignore/git",
    "is_dockerignore": "ignore/docker",
    "is_gomod": "manifest/gomod",
    "is_node_manifest": "manifest/node",
    "is_cargo_manifest": "manifest/cargo",
    "is_pipfile": "manifest/pipfile",
    "is_python_reqs": "manifest/python-reqs",
    "is_gemfile": "manifest/gemfile",
    "is_procfile": "platform/procfile",
    "is_vagrantfile": "platform/vagrant",
    "is_ds_store": "system/macos-ds-store",
    "is_localized": "system/macos-localized",
    "is_thumbs_db": "system/windows-thumbs-db",
    "is_desktop_ini": "system/windows-desktop-ini",
    "is_kde_directory": "system/linux-directory",
    "is_plist": "system/plist",
    "is_dmg": "disk-image/dmg",
    "is_iso": "disk-image/iso9660",
    "is_vhd": "disk-image/vhd",
    "is_vhdx": "disk-image/vhdx",
    "is_vmdk": "disk-image/vmdk",
    "is_qcow2": "disk-image/qcow2",
    "is_wim": "disk-image/wim",
    "is_pkg": "install/pkg",
    "is_deb": "install/deb",
    "is_rpm": "install/rpm",
    "is_appimage": "install/appimage",
    "is_class": "bytecode/jvm",
    "is_pyc": "bytecode/python",
    "is_wasm": "bytecode/wasm",
    "is_fits": "science/fits",
    "is_votable": "science/votable",
    "is_hdf5": "science/hdf5",
    "is_pds3": "science/pds3",
    "is_pds4": "science/pds4",
    "is_pds": "science/pds3,science/pds4",
    "is_cdf": "science/cdf",
    "is_database": "database/sqlite",
    "is_sqlite": "database/sqlite",
    "is_sqlite_wal": "database/sqlite-wal",
    "is_sqlite_shm": "database/sqlite-shm",
    "is_chromium_bookmarks": "browser/bookmarks-chromium",
    "is_safari_bookmarks": "browser/bookmarks-safari",
    "is_slack_export": "chat/slack-export",
    "is_discord_export": "chat/discord-export",
    "is_signal_export": "chat/signal-cli",
    "is_ttf": "font/ttf",
    "is_otf": "font/otf",
    "is_font_collection": "font/collection",
    "is_woff": "font/woff",
    "is_woff2": "font/woff2",
    "is_cr2": "image/raw-cr2",
    "is_cr3": "image/raw-cr3",
    "is_nef": "image/raw-nef",
    "is_arw": "image/raw-arw",
    "is_dng": "image/raw-dng",
    "is_raf": "image/raw-raf",
    "is_orf": "image/raw-orf",
    "is_rw2": "image/raw-rw2",
    "is_stl": "model3d/stl",
    "is_obj": "model3d/obj",
    "is_gltf": "model3d/gltf",
}

FLAG_OF = FLAGS
TYPES: dict[str, str] = {}
for _kind, _names in (("string", STRINGS), ("int", INTS), ("double", DOUBLES), ("timestamp", TIMES), ("list<string>", LISTS), ("bool", BOOLS)):
    TYPES |= dict.fromkeys(_names.split(), _kind)
TYPES |= dict.fromkeys(FLAG_OF, "bool") | {"bounding_box": "list<double>", "frontmatter": "map"}

SPARK_TYPES = {"string": "string", "int": "bigint", "double": "double", "bool": "boolean", "timestamp": "timestamp_ntz", "list<string>": "array<string>", "list<double>": "array<double>", "map": "variant"}
_ZEROS = {"string": "''", "int": "0L", "double": "0.0D", "bool": "false", "timestamp": "TIMESTAMP_NTZ'0001-01-01 00:00:00'", "list<string>": "cast(array() as array<string>)", "list<double>": "cast(array() as array<double>)", "map": "parse_json('{}')"}


def zero(kind: str) -> Column:
    """The value a missing variable of this type has in expressions."""
    return F.expr(_ZEROS[kind])


def flag(name: str, content_type: Column) -> Column:
    """The content-type test a flag stands for."""
    tests = [content_type.startswith(x[:-1]) if x.endswith("*") else content_type == x for x in FLAG_OF[name].split(",")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def kind_of(spark_type: str) -> str | None:
    """The expression type of a Spark column type; None where expressions have none."""
    if spark_type in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if spark_type in ("double", "float"):
        return "double"
    return {v: k for k, v in SPARK_TYPES.items()}.get(spark_type) or {"date": "timestamp", "timestamp": "timestamp"}.get(spark_type)
