"""Fingerprints, culprits, device keys and user agents as column expressions, all JVM-side.

A fingerprint is the SHA-256 of: the client's own elements; else the exception's type and the signatures of up to five
frames (those in the app if any are), last first; else the type and the masked message.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FRAMES = 5
_HEX = "[0-9a-fA-F]"
_UUID = rf"(?<!\S)[\"',.]*{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}[\"',.]*(?!\S)"


def mask(c: Column) -> Column:
    """Volatile parts of words replaced: UUIDs, 0x addresses, runs of digits."""
    c = F.regexp_replace(c, _UUID, "{uuid}")
    c = F.regexp_replace(c, rf"(?<!\S)0x{_HEX}+(?!\S)", "{addr}")
    return F.regexp_replace(c, "[0-9]+", "{n}")


def message_mask(c: Column) -> Column:
    return F.trim(F.regexp_replace(mask(F.lower(c)), r"\s+", " "))


def symbol(c: Column) -> Column:
    return mask(F.trim(c))


def type_mask(c: Column) -> Column:
    return symbol(F.split_part(c, F.lit("("), F.lit(1)))


def file_mask(c: Column) -> Column:
    """The base name without query; of three or more dotted parts, those that look like a hash are dropped."""
    base = F.trim(F.regexp_extract(F.regexp_extract(c, r"^([^?#]*)", 1), r"([^/\\]*)$", 1))
    parts = F.split(base, r"\.")
    kept = F.filter(parts, lambda p: ~(p.rlike(f"^{_HEX}{{6,40}}$") & p.rlike("[0-9]")))
    return mask(F.when((F.size(parts) >= 3) & (F.size(kept) >= 2), F.array_join(kept, ".")).otherwise(base))


def frame_signature(f: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    func, module, file = f["function"], f["module"], f["filename"]
    return F.when(some(module) & some(func), F.concat(symbol(module), F.lit("::"), symbol(func))).when(some(func), symbol(func)).when(file.isNotNull(), file_mask(file)).otherwise("?")


def signatures(stack: Column) -> Column:
    """Signatures of the frames that count, the last one first."""
    own = F.filter(stack, lambda f: F.coalesce(f["in_app"], F.lit(False)))
    pool = F.reverse(F.when(F.size(own) > 0, own).otherwise(F.coalesce(stack, F.slice(own, 1, 0))))
    return F.transform(F.slice(pool, 1, FRAMES), frame_signature)


def fingerprint(client: Column, kind: Column, value: Column, stack: Column, message: Column) -> Column:
    own = F.when(F.size(client) > 0, F.array_join(client, "\n", ""))
    frames = signatures(stack)
    by_frames = F.concat_ws("\n", F.array(type_mask(kind)), frames)
    by_message = F.concat(type_mask(kind), F.lit("\n"), message_mask(F.coalesce(value, message, F.lit(""))))
    bare = F.concat(F.lit("message\n"), message_mask(F.coalesce(message, F.lit("unknown"))))
    text = F.when(own.isNotNull(), own).when(kind.isNull(), bare).when(F.coalesce(F.size(stack), F.lit(0)) > 0, by_frames).otherwise(by_message)
    return F.sha2(text, 256)


def culprit(stack: Column) -> Column:
    """``function (file:line)`` of the last frame in the app, or of the last; empty without frames."""
    own = F.filter(stack, lambda f: F.coalesce(f["in_app"], F.lit(False)))
    f = F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(stack, F.lit(-1)))
    func = F.coalesce(f["function"], F.lit("?"))
    place = F.when(f["lineno"].isNotNull(), F.concat(f["filename"], F.lit(":"), f["lineno"].cast("string"))).otherwise(f["filename"])
    return F.when(f.isNull(), "").when(f["filename"].isNull(), func).otherwise(F.concat(func, F.lit(" ("), place, F.lit(")")))


def user_agent(ua: Column) -> dict[str, Column]:
    """name, version, os, os_version and category of a browser's user agent string; null where unknown."""
    first = lambda *p: F.coalesce(*[F.nullif(F.regexp_extract(ua, x, 1), F.lit("")) for x in p])
    name = F.when(ua.rlike("Edg(e|A|iOS)?/"), "Edge").when(ua.rlike("OPR/|Opera"), "Opera").when(ua.rlike("(Firefox|FxiOS)/"), "Firefox").when(ua.rlike("(Chrome|CriOS)/"), "Chrome").when(ua.rlike("Version/.*Safari/"), "Safari")
    os = F.when(ua.contains("Android"), "Android").when(ua.rlike("iPhone|iPad|iPod"), "iOS").when(ua.contains("Windows"), "Windows").when(ua.contains("Mac OS X"), "Mac OSX").when(ua.contains("Linux"), "Linux")
    return {
        "name": name, "version": first(r"(?:Edg(?:e|A|iOS)?|OPR)/([\d.]+)", r"(?:Firefox|FxiOS)/([\d.]+)", r"(?:Chrome|CriOS)/([\d.]+)", r"Version/([\d.]+)"), "os": os,
        "os_version": F.translate(first(r"Android ([\d.]+)", r"(?:iPhone|CPU) OS ([\d_]+)", r"Windows NT ([\d.]+)", r"Mac OS X ([\d_.]+)"), "_", "."),
        "category": F.when(ua.rlike("(?i)bot|crawler|spider"), "crawler").when(ua.rlike("Mobile|iPhone|Android"), "smartphone").when(os.isNotNull(), "pc"),
    }


def device_fields(context: Column, ua: Column | None = None) -> dict[str, Column]:
    """family, model, os_name, os_version, arch, browser and device_key of a JSON context."""
    at = lambda p: F.nullif(F.trim(F.get_json_object(context, p)), F.lit(""))
    agent = user_agent(ua) if ua is not None else {}
    either = lambda p, k: F.coalesce(at(p), agent[k]) if agent else at(p)
    out = {"family": at("$.device.family"), "model": at("$.device.model"), "os_name": either("$.os.name", "os"), "os_version": either("$.os.version", "os_version"), "arch": at("$.device.arch"), "browser": either("$.runtime.name", "name")}
    joined = F.nullif(F.concat_ws("|", *[out[k] for k in ("family", "model", "os_name", "arch", "browser")]), F.lit(""))
    return {**out, "device_key": F.coalesce(at("$.device.device_id"), joined)}
