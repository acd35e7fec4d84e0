"""Queries of the scalar functions, over the signal view."""

from __future__ import annotations

from pyspark.sql import functions

from ..functions import scalar
from .deferred import Later
from .registry import per_row

F, S = Later(functions), Later(scalar)
c, lit = F.col, F.lit
LAT0, LON0 = 52.4, -1.5
_H = "2 * {r}::double * asin(sqrt({a}))"
_A = "(pow(sin(radians(lat - 52.4::double) / 2), 2) + cos(radians(52.4::double)) * cos(radians(lat)) * pow(sin(radians(lon - (-1.5::double)) / 2), 2))"
_PMOD = lambda x, m: f"((({x}) % {m} + {m}) % {m})"
_WRAP = lambda x: f"({_PMOD(f'({x}) + pi()', '(2 * pi())')} - pi())"
unit3 = lambda a, b, d: F.element_at(F.array(lit(a), lit(b), lit(d)), (c("i") % 3 + 1).cast("int"))
sunit = lambda a, b, d: f"case i % 3 when 0 then {a} when 1 then {b} else {d} end"
psi, ve, vn = F.radians("heading_deg"), c("speed") * 0.6, c("speed") * 0.8

per_row("p01_accel_unit", {"a": (S.accel_to_ms2(c("acc_x"), unit3("m/s2", "g", "cm/s2")), f"acc_x * {sunit('1.0::double', '9.80665::double', '0.01::double')}")})
per_row("p02_gyro_unit", {"g": (S.gyro_to_rad_s(c("gyro_z"), unit3("rad/s", "deg/s", "mdps")), f"gyro_z * {sunit('1.0::double', 'radians(1.0::double)', 'radians(1.0::double) / 1000')}")}, 9)
per_row("p03_mag_unit", {"m": (S.mag_to_ut(c("acc_y"), unit3("uT", "mT", "gauss")), f"acc_y * {sunit('1.0::double', '1000.0::double', '100.0::double')}")})
_frd = {f: S.to_frd(c("acc_x"), c("acc_y"), c("acc_z"), f) for f in ("FLU", "ENU", "NED")}
per_row("p04_frame_transform", {f"{f.lower()}_{a}": (_frd[f][k], s) for f, sql in {"FLU": ("acc_x", "-acc_y", "-acc_z"), "ENU": ("acc_y", "acc_x", "-acc_z"), "NED": ("acc_x", "acc_y", "acc_z")}.items() for k, (a, s) in enumerate(zip("xyz", sql))})
per_row("p05_bias_correction", {"a": (S.remove_bias(c("acc_x"), 0.12), "acc_x - 0.12::double"), "g": (S.remove_bias(c("gyro_z"), -0.01), "gyro_z + 0.01::double")})
_en = S.to_enu(c("lat"), c("lon"), lit(LAT0), lit(LON0))
_sqle, _sqln = "radians(lon - (-1.5::double)) * 6378137.0::double * cos(radians(52.4::double))", "radians(lat - 52.4::double) * 6378137.0::double"
per_row("p08_enu_to_latlon", {"lat2": (S.from_enu(_en[0], _en[1], lit(LAT0), lit(LON0))[0], "lat"), "lon2": (S.from_enu(_en[0], _en[1], lit(LAT0), lit(LON0))[1], "lon")})
per_row("p09_haversine", {"d": (S.haversine_m(lit(LAT0), lit(LON0), c("lat"), c("lon")), _H.format(r="6378137.0", a=f"least(greatest({_A}, 0.0::double), 1.0::double)"))}, 4)
per_row("p10_haversine_mean_radius", {"d": (S.haversine_m(lit(LAT0), lit(LON0), c("lat"), c("lon"), S.EARTH_MEAN_M, False), _H.format(r="6371000.0", a=_A))}, 4)
_dlo = "radians(lon - (-1.5::double))"
_bear = f"degrees(atan2(sin({_dlo}) * cos(radians(lat)), cos(radians(52.4::double)) * sin(radians(lat)) - sin(radians(52.4::double)) * cos(radians(lat)) * cos({_dlo})))"
per_row("p11_initial_bearing", {"b": (S.bearing_deg(lit(LAT0), lit(LON0), c("lat"), c("lon")), _PMOD(_bear, "360.0::double"))}, 4)
per_row("p12_wrap_degrees", {"a": (S.wrap_deg(c("heading_deg") * 3 - 500.5), f"{_PMOD('heading_deg * 3 - 500.5::double + 180', '360.0::double')} - 180")})
per_row("p13_wrap_radians", {"a": (S.wrap_rad(psi * 3 - 8.5), _WRAP("radians(heading_deg) * 3 - 8.5::double"))})
per_row("p14_angle_difference", {"a": (S.angle_diff(psi, lit(1.25)), _WRAP("radians(heading_deg) - 1.25::double"))})
per_row("p15_angle_average", {"a": (S.angle_avg(psi, lit(1.25)), f"radians(heading_deg) + {_WRAP('1.25::double - radians(heading_deg)')} * 0.5::double")})
_ve, _vn, _psi = "(speed * 0.6::double)", "(speed * 0.8::double)", "radians(heading_deg)"
per_row("p16_lateral_forward_velocity", {"lateral": (S.lateral_velocity(ve, vn, psi), f"{_ve} * cos({_psi}) - {_vn} * sin({_psi})"), "forward": (S.forward_velocity(ve, vn, psi), f"{_ve} * sin({_psi}) + {_vn} * cos({_psi})")})
per_row("p17_region", {"region": (S.region(c("k") * 1.0 - 20, c("value") / 30.0 - 5), "case when k - 20 between 4 and 14 and value / 30.0::double - 5 between 2 and 15 then 'Nigeria' when k - 20 between 41 and 52 and value / 30.0::double - 5 between -5 and 9 then 'France' when k - 20 between 49 and 61 and value / 30.0::double - 5 between -8 and 2 then 'UK' else 'other' end")}, None)
_seq = F.concat(lit("drive"), c("k"), F.element_at(F.array(lit("a"), lit(""), lit("B")), (c("i") % 3 + 1).cast("int")))
_sqlseq = f"('drive' || k || {sunit(chr(39) + 'a' + chr(39), chr(39) * 2, chr(39) + 'B' + chr(39))})"
per_row("p18_drive_group", {"grp": (S.drive_group(_seq), f"case when regexp_matches({_sqlseq}, '[0-9][a-z]$') then left({_sqlseq}, length({_sqlseq}) - 1) else {_sqlseq} end")}, None)
per_row("p19_satellite_split", {"n": (S.split_sats(F.concat(c("k"), lit(" / 99"))), "cast(k as double)"), "bad": (S.split_sats(c("event_type")), "cast(null as double)")}, None)
per_row("p20_kmh_to_ms", {"v": (S.kmh_to_ms(c("value")), "value / 3.6::double")})
per_row("p21_trip_label", {"label": (S.trip_label(c("event_type"), c("trip_key").cast("string")), "event_type || '/' || trip_key")}, None)
per_row("p23_pothole", {"fixed": (S.pothole(c("acc_z") * 2.6), "least(abs(acc_z * 2.6::double - 9.81::double), abs(acc_z * 2.6::double + 9.81::double)) > 15"), "legacy": (S.pothole(c("acc_z"), True), "abs(acc_z - 9.81::double) > 15 or abs(acc_z + 9.81::double) > 15")}, None)
_norm = "abs(sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) - 9.81::double) < 0.5"
per_row("p24_stationary_server", {"still": (S.stationary(c("acc_x"), c("acc_y"), c("acc_z"), F.abs("gyro_z")), f"{_norm} and abs(gyro_z) < 0.08"), "zupt": (S.stationary(c("acc_x"), c("acc_y"), c("acc_z"), F.abs("gyro_z"), 0.15), f"{_norm} and abs(gyro_z) < 0.15")}, None)
per_row("p25_stationary_edge", {"still": (S.stationary_edge(c("acc_x"), c("acc_y"), c("acc_z"), F.abs("gyro_z"), c("speed") / 20), f"{_norm} and abs(gyro_z) < 0.08 and speed / 20 < 0.3")}, None)
per_row("p26_dt_clamp", {"dt": (S.clamp_dt(c("gyro_z") * 2), "greatest(0.001::double, least(gyro_z * 2, 0.5::double))")})
_r = S.rotate(S.rotation(psi, c("pitch"), c("roll")), c("acc_x"), c("acc_y"), c("acc_z"))
_cy, _sy, _cp, _sp, _cr, _sr = "cos(radians(heading_deg))", "sin(radians(heading_deg))", "cos(pitch)", "sin(pitch)", "cos(roll)", "sin(roll)"
per_row("p27_rotation", {
    "x": (_r[0], f"{_cy}*{_cp}*acc_x + ({_cy}*{_sp}*{_sr} - {_sy}*{_cr})*acc_y + ({_cy}*{_sp}*{_cr} + {_sy}*{_sr})*acc_z"),
    "y": (_r[1], f"{_sy}*{_cp}*acc_x + ({_sy}*{_sp}*{_sr} + {_cy}*{_cr})*acc_y + ({_sy}*{_sp}*{_cr} - {_cy}*{_sr})*acc_z"),
    "z": (_r[2], f"-{_sp}*acc_x + {_cp}*{_sr}*acc_y + {_cp}*{_cr}*acc_z"),
})
_len = F.sqrt(c("acc_x") ** 2 + c("acc_y") ** 2 + c("acc_z") ** 2)
_t = S.rotate(S.tilt_rotation(c("acc_x") / _len, c("acc_y") / _len, c("acc_z") / _len), c("acc_x"), c("acc_y"), c("acc_z"))
per_row("p28_minimal_rotation", {"x": (_t[0], "0.0::double"), "y": (_t[1], "0.0::double"), "z": (_t[2], "sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z)")})
per_row("p29_heading_correction", {"h": (S.correct_heading(psi, 2.5), _WRAP("radians(heading_deg) + 2.5::double"))})
_re = S.recentre(c("speed") * 10, c("gyro_z") * 100, lit(52.0), lit(-1.0), lit(52.4), lit(-1.5))
_lat2, _lon2 = "(52.0::double + degrees(gyro_z * 100 / 6378137.0::double))", "(-1.0::double + degrees(speed * 10 / (6378137.0::double * cos(radians(52.0::double)))))"
per_row("p30_graph_recentring", {"e": (_re[0], f"radians({_lon2} - (-1.5::double)) * 6378137.0::double * cos(radians(52.4::double))"), "n": (_re[1], f"radians({_lat2} - 52.4::double) * 6378137.0::double")}, 4)
_kind = F.element_at(F.array(*map(lit, ["depart", "arrive", "turn", "merge", "fork", "on ramp", "off ramp", "roundabout", "rotary", "other"])), (c("k") % 10 + 1).cast("int"))
_name = F.when(c("i") % 2 == 0, c("event_type")).otherwise(lit(""))
_mod = F.when(c("i") % 3 == 0, lit("slight left")).otherwise(lit("right"))
_road = "(case when i % 2 = 0 then ' onto ' || event_type else '' end)"
per_row("p31_turn_instruction", {"text": (S.turn_instruction(_kind, _mod, _name), f"case k % 10 when 0 then 'Head' || case when i % 2 = 0 then {_road} else ' along route' end when 1 then 'Arrive at destination' when 2 then case when i % 3 = 0 then 'Slight left' else 'Right' end || ' turn' || {_road} when 3 then 'Merge' || {_road} when 4 then 'Keep ' || case when i % 3 = 0 then 'left' else 'right' end || {_road} when 5 then 'Take the ramp' || {_road} when 6 then 'Take the exit' || {_road} when 7 then 'Enter the roundabout' || {_road} when 8 then 'Enter the rotary' || {_road} else 'Continue' || {_road} end")}, None)
_ss = S.straight_steps(lit(LAT0), lit(LON0), c("lat"), c("lon"))
per_row("p32_straight_steps", {"distance_m": (_ss[0]["distance_m"], _H.format(r="6371000.0", a=_A)), "duration_s": (_ss[0]["duration_s"], _H.format(r="6371000.0", a=_A) + " / 8.33::double"), "end_lat": (_ss[1]["lat"], "lat"), "end_m": (_ss[1]["distance_m"], "0.0::double")}, 7)
_missing = F.when(c("k") % 5 != 0, c("roll"))
per_row("p33_sample_predicates", {"mag": (S.has_magnetometer(c("acc_x"), lit(0.0), lit(0.0)), "acc_x <> 0"), "orientation": (S.has_orientation(_missing, c("pitch"), c("heading_deg")), "k % 5 <> 0")}, None)
per_row("p34_zero_fill", {"x": (S.zero_fill(_missing), "case when k % 5 <> 0 then roll else 0.0::double end")})
_mh = S.mode_label(c("i") > 2, c("gnss_valid"), c("k") % 4 - 2)
per_row("p35_mode_label", {"mode": (_mh[0], "case when i <= 2 then 'GNSS_REACQUIRE' when gnss_valid and k % 4 > 2 then 'GNSS_REACQUIRE' when gnss_valid then 'GNSS_AIDED' else 'DR_ACTIVE' end"), "health": (_mh[1], "case when i <= 2 then 'OUTAGE' when gnss_valid and k % 4 > 2 then 'DEGRADED' when gnss_valid then 'OK' else 'OUTAGE' end")}, None)
per_row("p36_sync_status", {"status": (S.sync_status(c("k") / 100.0, c("value") - 50), "case when k / 100.0::double >= 0.75 and abs(value - 50) <= 300 then 'verified_synced' when k / 100.0::double >= 0.5 then 'synced_authors' else 'sync_suspect' end")}, None)
per_row("p37_gps_decay", {"v": (S.gps_decay(c("speed"), c("t")), "speed * exp(-t / 30.0::double)")})
per_row("p38_file_kind", {"kind": (S.file_kind(F.concat(F.element_at(F.array(lit("S-"), lit("V-"), lit("x-")), (c("i") % 3 + 1).cast("int")), c("k"))), sunit("'phone'", "'vehicle'", "'other'"))}, None)
per_row("s11_header_cleaning", {"h": (S.clean_header(F.concat(lit("  GPS_"), c("event_type"), lit(" (m/s²)"))), "'gps ' || event_type || ' m s'")}, None)
per_row("f02_valid_origin", {"ok": (F.coalesce(c("lat").between(-90, 90) & c("lon").between(-180, 180) & ~((c("lat") == 0) & (c("lon") == 0)), lit(False)), "lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")}, None)
per_row("f12_heading_gate", {"ok": (F.least(F.abs(S.wrap_rad(psi - 1.0)), F.abs(S.wrap_rad(psi - 1.0 + F.pi()))) <= F.radians(lit(50.0)), f"least(abs({_WRAP('radians(heading_deg) - 1.0::double')}), abs({_WRAP('radians(heading_deg) - 1.0::double + pi()')})) <= radians(50.0::double)")}, None)
per_row("r01_feature_vector", {"v": (F.array(*[F.round(x, 6) for x in ("acc_x", "acc_y", "acc_z", "gyro_z", "roll", "pitch")]), "[round(acc_x, 6), round(acc_y, 6), round(acc_z, 6), round(gyro_z, 6), round(roll, 6), round(pitch, 6)]")}, None)
per_row("r06_coordinate_swap", {"p": (F.transform(F.array(F.array("lon", "lat")), lambda x: F.array(x[1], x[0]))[0], "[lat, lon]")}, None)
