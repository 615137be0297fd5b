"""SQL text of the views behind the queries, for DuckDB."""
from __future__ import annotations

import re

from terracast import config as C
from terracast.functions.geodesy import ZONE_43N as Z


def fix(x: str, places: int) -> str:
    k = f"1e{places}"
    return f"(floor(({x})*{k}+0.5003e0)/{k})"


def even(x: str, places: int) -> str:
    k = f"1e{places}"
    return f"(round_even(({x})*{k}, 0)/{k})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def qc(x: str, variable: str) -> str:
    (a, b), (c, d) = C.HARD_LIMITS[variable], C.SOFT_LIMITS[variable]
    return (f"(case when {x} is null then 'MISSING' when {x} < {a} or {x} > {b} then 'INVALID' "
            f"when {x} < {c} or {x} > {d} then 'SUSPICIOUS' else 'VALID' end)")


def clip(x: str, lo: str, hi: str) -> str:
    return f"(case when {x} is not null then least(greatest({x}, {lo}), {hi}) end)"


def forward(src: str, lon: str, lat: str, x: str = "x", y: str = "y") -> str:
    """src with easting and northing."""
    a0, a2, a4, a6 = (f"({v!r}::double)" for v in Z.arc)
    p2 = f"({Z.second_ecc2!r}::double)"
    return f"""(select * exclude (ph, dl, nn, tn, cc, aa, mm),
      {Z.false_easting!r}::double + 0.9996e0*nn*(aa*(1e0 + aa*aa/6e0*((1e0-tn*tn+cc) + aa*aa/20e0*(5e0-18e0*tn*tn+tn*tn*tn*tn+72e0*cc-58e0*{p2})))) as {x},
      0.9996e0*(mm + nn*tn*(aa*aa/2e0*(1e0 + aa*aa/12e0*((5e0-tn*tn+9e0*cc+4e0*cc*cc) + aa*aa/30e0*(61e0-58e0*tn*tn+tn*tn*tn*tn+600e0*cc-330e0*{p2}))))) as {y}
      from (select *, {Z.semi_major!r}::double/sqrt(1e0-({Z.ecc2!r}::double)*sin(ph)*sin(ph)) as nn, tan(ph) as tn, {p2}*cos(ph)*cos(ph) as cc, dl*cos(ph) as aa,
        {Z.semi_major!r}::double*({a0}*ph+{a2}*sin(2e0*ph)+{a4}*sin(4e0*ph)+{a6}*sin(6e0*ph)) as mm
        from (select *, radians({lat}) as ph, radians({lon}-75e0) as dl from {src})))"""


def inverse(src: str, x: str, y: str, lon: str = "longitude", lat: str = "latitude") -> str:
    """src with degree columns."""
    f2, f4, f6 = (f"({v!r}::double)" for v in Z.footpoint)
    e2, p2, a = f"({Z.ecc2!r}::double)", f"({Z.second_ecc2!r}::double)", f"({Z.semi_major!r}::double)"
    return f"""(select * exclude (mu, ph, tn, cs, w, cc, dd),
      75e0+degrees(dd/cs*(1e0-dd*dd/6e0*((1e0+2e0*tn*tn+cc)-dd*dd/20e0*(5e0-2e0*cc+28e0*tn*tn-3e0*cc*cc+8e0*{p2}+24e0*tn*tn*tn*tn)))) as {lon},
      degrees(ph-w/(1e0-{e2})*tn*dd*dd/2e0*(1e0-dd*dd/12e0*((5e0+3e0*tn*tn+10e0*cc-4e0*cc*cc-9e0*{p2})-dd*dd/30e0*(61e0+90e0*tn*tn+298e0*cc+45e0*tn*tn*tn*tn-252e0*{p2})))) as {lat}
      from (select *, {p2}*cs*cs as cc, ({x}-500000e0)*sqrt(w)/({a}*0.9996e0) as dd
        from (select *, tan(ph) as tn, cos(ph) as cs, 1e0-{e2}*sin(ph)*sin(ph) as w
          from (select *, mu+{f2}*sin(2e0*mu)+{f4}*sin(4e0*mu)+{f6}*sin(6e0*mu) as ph
            from (select *, {y}/0.9996e0/({a}*({Z.arc[0]!r}::double)) as mu from {src})))))"""


LAT = "(10.20e0+((user_id*37)%120)/100e0)"
LON = "(76.60e0+((user_id*53)%70)/100e0)"
ELEV = "cast(200+((user_id*97)%1800) as double)"

VIEWS: dict[str, str] = {
    "v_station": f"select distinct user_id as station_id, {LAT} as latitude, {LON} as longitude, {ELEV} as station_elevation from events",
    "v_obs": f"""select event_id, user_id as station_id, date_trunc('hour',ts)::timestamp as "timestamp", {LAT} as latitude, {LON} as longitude, {ELEV} as station_elevation,
      case when event_id%19=0 then null else {fix('value*0.6e0-20e0', 2)} end as temperature,
      case when event_id%23=0 then null else {fix('fmod(value*3.7e0,108e0)', 2)} end as humidity,
      {fix('greatest(value-60e0,0e0)/4e0', 2)} as rainfall from events""",
    "v_point": """select row_number() over (order by latitude,longitude) as idx, 'FC_GRID_'||lpad(cast(row_number() over (order by latitude,longitude) as varchar),2,'0') as parent, latitude, longitude
      from (values (10.3e0),(10.6e0),(10.9e0),(11.2e0)) a(latitude), (values (76.7e0),(76.9e0),(77.1e0)) b(longitude)""",
    "v_fc": f"""select p.idx, p.parent, p.latitude, p.longitude, h.vt as valid_time, l.lead, h.vt - l.lead*interval 1 hour as issue_time,
      {fix('h.t+p.idx*0.3e0+l.lead*0.01e0', 2)} as forecast_temperature, least(100e0,{fix('40e0+h.t+p.idx', 2)}) as forecast_humidity,
      {fix('greatest(h.t-10e0,0e0)/10e0', 2)} as forecast_rainfall
      from (select date_trunc('hour',ts)::timestamp as vt, avg(value*0.6e0-20e0) as t from events group by 1) h, v_point p, (values (24),(48),(72)) l(lead)""",
    "v_site": """select station_id, 'FC_GRID_'||lpad(cast(station_id%12+1 as varchar),2,'0') as parent, 'GRID_'||lpad(cast(station_id+1 as varchar),5,'0') as grid_id,
      'GP_'||lpad(cast(station_id%40 as varchar),4,'0') as panchayat_id, (station_id%12+1)*25e0+300e0 as grid_elevation, 'GROUP_'||station_id as station_group from v_station""",
    "v_checked": f"""select *, case when qc_temperature='INVALID' or qc_humidity='INVALID' or qc_rainfall='INVALID' then 'INVALID'
      when qc_temperature='SUSPICIOUS' or qc_humidity='SUSPICIOUS' or qc_rainfall='SUSPICIOUS' then 'SUSPICIOUS' else 'VALID' end as qc_status
      from (select *, {qc('temperature','temperature')} as qc_temperature, {qc('humidity','humidity')} as qc_humidity, {qc('rainfall','rainfall')} as qc_rainfall from v_obs)""",
    "v_match": f"""select *, {even('observed_temperature-b2_temperature', 2)} as residual_temperature, {even('observed_humidity-b0_humidity', 2)} as residual_humidity from (
      select o.event_id, o.station_id, o."timestamp" as observation_time, f.valid_time, f.issue_time as forecast_issue_time, f.lead as lead_time_hours, s.parent as forecast_parent_id,
      s.grid_id, s.panchayat_id, s.grid_elevation, s.station_group, o.latitude as latitude_obs, o.longitude as longitude_obs, o.station_elevation, o.qc_status,
      o.temperature as observed_temperature, o.humidity as observed_humidity, o.rainfall as observed_rainfall, f.forecast_temperature, f.forecast_humidity, f.forecast_rainfall,
      f.forecast_temperature as b0_temperature, f.forecast_humidity as b0_humidity, f.forecast_rainfall as b0_rainfall,
      {even('f.forecast_temperature+(-0.0065e0)*(o.station_elevation-s.grid_elevation)', 2)} as b2_temperature, f.forecast_humidity as b2_humidity,
      case when o."timestamp" <= timestamp '2024-01-15 23:00:00' then 'TRAIN' when o."timestamp" <= timestamp '2024-01-22 23:00:00' then 'CALIBRATION' else 'TEST' end as split
      from v_checked o join v_site s on o.station_id=s.station_id join v_fc f on f.valid_time=o."timestamp" and f.parent=s.parent)""",
    "v_int": """select *, q90_temperature-q10_temperature as temperature_interval_width, q90_humidity-q10_humidity as humidity_interval_width from (select *,
      b2_temperature-(lead_time_hours/12e0+8e0) as q10_temperature, b2_temperature-0.5e0 as q50_temperature, b2_temperature+(lead_time_hours/8e0+6e0) as q90_temperature,
      b2_humidity-(lead_time_hours/6e0+20e0) as q10_humidity, b2_humidity+1e0 as q50_humidity, b2_humidity+(lead_time_hours/4e0+15e0) as q90_humidity,
      b2_temperature+1.5e0 as b3_temperature, b2_temperature*0.75e0+1e0 as ml_temperature, b2_humidity-2.5e0 as b3_humidity, b2_humidity*0.9e0+3e0 as ml_humidity from v_match)""",
    "v_pixel": """select cast(p_partkey//50 as int) as r, cast(p_partkey%50 as int) as c, p_retailprice/3e0 as z, [10,20,30,40,50,60,80][cast(1+(p_partkey*7919)%7 as int)] as cls from part""",
    "v_prob": """select d.doc_id, d.lang, d.source, l.quality as y, l.toxic as y2, ((d.doc_id*7919)%1000)/1000e0 as p, ((d.doc_id*7919)%1000)/1000e0*0.8e0+0.1e0 as p_cal from documents d join labels l using(doc_id)""",
    "v_unit": """select s_suppkey as unit_idx, 'GP_'||lpad(cast(s_suppkey as varchar),4,'0') as panchayat_id, s_name as panchayat_name, 'BLOCK_'||lpad(cast(s_nationkey as varchar),2,'0') as block_name, 'Coimbatore' as district_name,
      76.70e0+((s_suppkey*31)%50)/100e0 as cx, 10.35e0+((s_suppkey*17)%95)/100e0 as cy, 0.03e0+0.004e0*(s_suppkey%4) as rad from supplier""",
    "v_hex": f"""select unit_idx, panchayat_id, k, {fix('cx+rad*cos(k*pi()/3e0)', 6)} as x1, {fix('cy+rad*sin(k*pi()/3e0)', 6)} as y1,
      {fix('cx+rad*cos(((k+1)%6)*pi()/3e0)', 6)} as x2, {fix('cy+rad*sin(((k+1)%6)*pi()/3e0)', 6)} as y2 from v_unit, range(6) t(k)""",
    "v_raw": f"""select event_id, case when event_id%29<>0 then 'ST'||user_id end as station_id,
      case when event_id%17=0 then 'not-a-date' when event_id%13=0 then strftime(ts,'%Y-%m-%d') else strftime(ts,'%Y-%m-%d %H:%M:%S') end as "timestamp",
      case when event_id%31=0 then 'abc' when event_id%37<>0 then cast({LAT}+case when event_id%997=0 then 30e0 else 0e0 end as varchar) end as latitude,
      case when event_id%43=0 then '-' when event_id%41<>0 then cast({LON} as varchar) end as longitude,
      case when event_id%41=0 then 'n/a' when event_id%19<>0 then cast(value*0.6e0-20e0 as varchar) end as temperature,
      case when event_id%23<>0 then cast(fmod(value*3.7e0,108e0) as varchar) end as humidity,
      case when event_id%7<>0 then cast(greatest(value-60e0,0e0)*12e0 as varchar) end as rainfall,
      case when event_id%2=0 then cast(value*2.5e0+860e0 as varchar) end as pressure, case when event_id%5<>0 then cast(value*1.5e0-20e0 as varchar) end as wind_speed,
      case when event_id%11<>0 then cast({ELEV} as varchar) end as station_elevation from events""",
    "v_typed": """select *, try_strptime("timestamp", ['%Y-%m-%d %H:%M:%S','%Y-%m-%d']) as t, try_cast(latitude as double) as la, try_cast(longitude as double) as lo,
      try_cast(temperature as double) as xt, try_cast(humidity as double) as xh, try_cast(rainfall as double) as xr, try_cast(pressure as double) as xp, try_cast(wind_speed as double) as xw from v_raw""",
    "v_rawfc": """select case when k%53=0 then 'soon' else strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') end as forecast_issue_time,
      case when k%59<>0 then strftime(l_shipdate,'%Y-%m-%d %H:%M:%S') end as valid_time, case when k%61=0 then 'x' else cast(lead as varchar) end as lead_time,
      cast(10e0+l_suppkey%4 as varchar) as latitude, cast(76e0+l_suppkey%3 as varchar) as longitude, cast(l_quantity as varchar) as temperature,
      case when k%3<>0 then cast(l_tax*1000e0 as varchar) end as humidity, case when k%5<>0 then cast(l_discount*100e0 as varchar) end as rainfall
      from (select *, l_orderkey*7+l_linenumber as k, date_sub('hour', o_orderdate, l_shipdate) as lead from lineitem join orders on l_orderkey=o_orderkey)""",
    "v_typedfc": """select *, try_strptime(forecast_issue_time, '%Y-%m-%d %H:%M:%S') as it, try_strptime(valid_time, '%Y-%m-%d %H:%M:%S') as vt, try_cast(lead_time as double) as lt from v_rawfc""",
    "v_extent": "select min(latitude) as min_lat, max(latitude) as max_lat, min(longitude) as min_lon, max(longitude) as max_lon from v_station",
    "v_frame": f"""select any_value(min_lat) as min_lat, any_value(max_lat) as max_lat, any_value(min_lon) as min_lon, any_value(max_lon) as max_lon,
      cast(floor(min(x)/1000e0) as bigint) as ix0, cast(ceil(max(x)/1000e0) as bigint) as ix1, cast(floor(min(y)/1000e0) as bigint) as iy0, cast(ceil(max(y)/1000e0) as bigint) as iy1
      from {forward("(select e.*, la.v as la, lo.v as lo from v_extent e, (select unnest([min_lat,max_lat]) as v from v_extent) la, (select unnest([min_lon,max_lon]) as v from v_extent) lo)", "lo", "la")}""",
    "v_grid": f"""select 'GRID_'||lpad(cast(cell_idx as varchar),5,'0') as grid_id, * from (
      select row_number() over (order by iy, ix) as cell_idx, centroid_x, centroid_y, {fix('latitude', 6)} as latitude, {fix('longitude', 6)} as longitude,
        centroid_x-500e0 as min_x, centroid_y-500e0 as min_y, centroid_x+500e0 as max_x, centroid_y+500e0 as max_y
      from {inverse("(select f.*, gx.v as ix, gy.v as iy, gx.v*1000e0+500e0 as centroid_x, gy.v*1000e0+500e0 as centroid_y from v_frame f, (select unnest(range(ix0, ix1)) as v from v_frame) gx, (select unnest(range(iy0, iy1)) as v from v_frame) gy)", "centroid_x", "centroid_y")}
      where latitude between min_lat-0.02e0 and max_lat+0.02e0 and longitude between min_lon-0.02e0 and max_lon+0.02e0)""",
    "v_pointxy": f"select idx, parent, latitude, longitude, {even('x', 2)} as fx, {even('y', 2)} as fy from {forward('v_point', 'longitude', 'latitude')}",
    "v_parent": f"""select grid_id, d.parent as forecast_parent_id, {fix('d.d', 2)} as distance_to_forecast_grid_m from (
      select g.grid_id, min(struct_pack(d := {fix('sqrt((centroid_x-fx)*(centroid_x-fx)+(centroid_y-fy)*(centroid_y-fy))', 6)}, i := p.idx, parent := p.parent)) as d from v_grid g, v_pointxy p group by 1)""",
    "v_stationxy": f"select * from {forward('v_station', 'longitude', 'latitude', 'station_x', 'station_y')}",
    "v_pip": """select g.grid_id, u.unit_idx from v_grid g join (select unit_idx, min(x1) as bx1, max(x1) as bx2, min(y1) as by1, max(y1) as by2 from v_hex group by 1) u
      on g.longitude between u.bx1 and u.bx2 and g.latitude between u.by1 and u.by2
      where (select count(*) from v_hex e where e.unit_idx=u.unit_idx and (e.y1 > g.latitude) <> (e.y2 > g.latitude) and g.longitude < (e.x2-e.x1)*(g.latitude-e.y1)/(e.y2-e.y1)+e.x1) % 2 = 1
      or exists (select 1 from v_hex e where e.unit_idx=u.unit_idx and (e.x2-e.x1)*(g.latitude-e.y1)-(e.y2-e.y1)*(g.longitude-e.x1)=0
        and g.longitude between least(e.x1,e.x2) and greatest(e.x1,e.x2) and g.latitude between least(e.y1,e.y2) and greatest(e.y1,e.y2))""",
    "v_centroid": """select unit_idx, sum((x1+x2)*(x1*y2-x2*y1))/(3e0*sum(x1*y2-x2*y1)) as ax, sum((y1+y2)*(x1*y2-x2*y1))/(3e0*sum(x1*y2-x2*y1)) as ay from v_hex group by 1""",
    "v_assign": f"""select g.grid_id, a.unit_idx, a.assignment_mode, u.panchayat_id, u.panchayat_name, u.block_name, u.district_name from (
      select grid_id, min(unit_idx) as unit_idx, 'centroid_contains' as assignment_mode from v_pip group by 1
      union all
      select grid_id, k.i, 'nearest_fallback' from (select g.grid_id, min(struct_pack(d := {fix('sqrt((longitude-ax)*(longitude-ax)+(latitude-ay)*(latitude-ay))', 6)}, i := c.unit_idx)) as k
        from (select * from v_grid where grid_id not in (select grid_id from v_pip)) g, v_centroid c group by 1)
      ) a join v_grid g using(grid_id) join v_unit u on u.unit_idx=a.unit_idx""",
    "v_hexm": f"""select unit_idx, k, x1m as x1, y1m as y1, x2m as x2, y2m as y2 from {forward(forward("v_hex", "x1", "y1", "x1m", "y1m"), "x2", "y2", "x2m", "y2m")}""",
    "v_water": f"""select grid_id, case when bool_or(inn) then 0e0 else {fix('min(d)', 2)} end as distance_to_nearest_water from (
      select grid_id, unit_idx, sum(cast((y1 > cy) <> (y2 > cy) and cx < (x2-x1)*(cy-y1)/(y2-y1)+x1 as int)) % 2 = 1 as inn, min({fix('sqrt((cx-(x1+t*dx))*(cx-(x1+t*dx))+(cy-(y1+t*dy))*(cy-(y1+t*dy)))', 6)}) as d
      from (select *, least(greatest(((cx-x1)*dx+(cy-y1)*dy)/(dx*dx+dy*dy),0e0),1e0) as t from (select g.grid_id, centroid_x as cx, centroid_y as cy, e.*, x2-x1 as dx, y2-y1 as dy from v_grid g, v_hexm e)) group by 1, 2) group by 1""",
    "v_near9": """select p.r, p.c, p.z, list(q.z order by dr, dc) as w from v_pixel p, (select unnest([-1,0,1]) as dr) a, (select unnest([-1,0,1]) as dc) b, (select max(r) as mr from v_pixel) m, v_pixel q
      where q.r = least(greatest(p.r+dr,0),mr) and q.c = least(greatest(p.c+dc,0),least(49, (select max(c) from v_pixel where r=least(greatest(p.r+dr,0),mr)))) group by all""",
    "v_terrain": """select r, c, z, slope, case when slope < 0.1e0 then 0e0 else case when a < 0 then a + 360e0 else a end end as aspect, tri from (
      select r, c, z, degrees(atan(sqrt(gx*gx+gy*gy))) as slope, degrees(atan2(-gy,gx)) as a, tri from (select r, c, z,
        ((w[3]+2e0*w[6]+w[9])-(w[1]+2e0*w[4]+w[7]))/240e0 as gx, ((w[7]+2e0*w[8]+w[9])-(w[1]+2e0*w[2]+w[3]))/240e0 as gy, sqrt(list_sum(list_transform(w, lambda v: (v-z)*(v-z)))) as tri from v_near9))""",
    "v_cellpix": """select grid_id, greatest(least(cast(trunc((longitude-76.60e0)/(77.30e0-76.60e0)*nc) as int), nc-1), 0) as pc, greatest(least(cast(trunc((11.40e0-latitude)/(11.40e0-10.20e0)*nr) as int), nr-1), 0) as pr
      from v_grid, (select max(r)+1 as nr, max(c)+1 as nc from v_pixel)""",
    "v_window": "select k.grid_id, p.r, p.c, p.z, p.cls from v_cellpix k join v_pixel p on p.r between k.pr-5 and k.pr+5 and p.c between k.pc-5 and k.pc+5",
    "v_fcday": f"""select idx, parent, date_trunc('day', valid_time)::timestamp as valid_time, lead, {fix('avg(forecast_temperature)', 2)} as forecast_temperature, {fix('avg(forecast_humidity)', 2)} as forecast_humidity, {fix('avg(forecast_rainfall)', 2)} as forecast_rainfall from v_fc group by 1, 2, 3, 4""",
    "v_testday": """select distinct strftime("timestamp",'%Y-%m-%d') as day from v_obs where "timestamp" > timestamp '2024-01-22 23:00:00'""",
    "v_master": f"""select g.*, t.elevation_mean, p.forecast_parent_id, p.distance_to_forecast_grid_m, a.panchayat_id, a.panchayat_name, a.block_name, a.district_name, a.assignment_mode from v_grid g join v_parent p using (grid_id) join v_assign a using (grid_id)
      left join (select grid_id, {fix('avg(z)', 2)} as elevation_mean from v_window group by 1) t using (grid_id)""",
    "v_gridp": """select *, p1 as prob_1mm, p1*0.4e0 as prob_10mm, p1*p1 as prob_25mm from (select m.*, strftime(f.valid_time,'%Y-%m-%d') as observation_time, f.lead as lead_time_hours, f.forecast_temperature, f.forecast_humidity, f.forecast_rainfall,
      sin(2e0*pi()*dayofyear(f.valid_time)/365.25e0) as day_of_year_sin, cos(2e0*pi()*dayofyear(f.valid_time)/365.25e0) as day_of_year_cos, month(f.valid_time)::int as month, ((cell_idx*37+f.lead+day(f.valid_time)*11)%1000)/1000e0 as p1
      from v_master m join v_fcday f on f.parent=m.forecast_parent_id where strftime(f.valid_time,'%Y-%m-%d') in (select day from v_testday))""",
    "v_village": """select panchayat_id, observation_time as "timestamp", lead_time_hours as lead_time, avg(prob_1mm) as rain_probability_1mm, avg(prob_10mm) as rain_probability_10mm, avg(prob_25mm) as rain_probability_25mm,
      quantile_cont(prob_1mm,0.1e0) as rain_probability_1mm_p10, quantile_cont(prob_1mm,0.9e0) as rain_probability_1mm_p90, quantile_cont(prob_10mm,0.1e0) as rain_probability_10mm_p10, quantile_cont(prob_10mm,0.9e0) as rain_probability_10mm_p90,
      quantile_cont(prob_25mm,0.1e0) as rain_probability_25mm_p10, quantile_cont(prob_25mm,0.9e0) as rain_probability_25mm_p90, coalesce(stddev_samp(prob_1mm),0e0) as spatial_spread_1mm, coalesce(stddev_samp(prob_10mm),0e0) as spatial_spread_10mm,
      coalesce(stddev_samp(prob_25mm),0e0) as spatial_spread_25mm, count(*) as grid_cell_count, case when count(*) < 3 then 'SUBGRID_RANGE_UNRESOLVED' else 'OK' end as aggregation_status from v_gridp group by 1, 2, 3""",
    "v_profile": f"""select u.panchayat_id, coalesce(m.pn, u.panchayat_name) as panchayat_name, coalesce(m.bn, u.block_name) as block_name, 'Coimbatore' as district_name, coalesce(m.la, p.my) as latitude, coalesce(m.lo, p.mx) as longitude,
      coalesce({fix('m.z', 1)}, 0e0) as elevation_mean, u.unit_idx+0.5e0 as area_sq_km, m.n as grid_cell_count, m.assignment_mode from v_unit u
      join (select unit_idx, (sum(x1)+max(x1) filter (k=0))/7e0 as mx, (sum(y1)+max(y1) filter (k=0))/7e0 as my from v_hex group by 1) p using (unit_idx)
      left join (select panchayat_id, arg_min(panchayat_name, grid_id) as pn, arg_min(block_name, grid_id) as bn, arg_min(assignment_mode, grid_id) as assignment_mode, avg(latitude) as la, avg(longitude) as lo, avg(elevation_mean) as z, count(*) as n from v_master group by 1) m using (panchayat_id)""",
    "v_profst": f"""select panchayat_id, k.s as nearest_station_id, {fix('k.d', 2)} as nearest_station_distance_km from (select panchayat_id,
      min(struct_pack(d := {fix('sqrt(((p.latitude-s.latitude)*111e0)*((p.latitude-s.latitude)*111e0)+((p.longitude-s.longitude)*111e0*cos(radians(p.latitude)))*((p.longitude-s.longitude)*111e0*cos(radians(p.latitude))))', 6)}, s := s.station_id)) as k from v_profile p, v_station s group by 1)""",
    "v_weather": """select station_id, strftime(observation_time,'%Y-%m-%d') as day, lead_time_hours, arg_max(ml_temperature, (observation_time, event_id)) as ml_temperature, arg_max(ml_humidity, (observation_time, event_id)) as ml_humidity, arg_max(ml_temperature between -10 and 60 and ml_humidity between 0 and 100, (observation_time, event_id)) as ok from v_int where ml_temperature is not null and ml_humidity is not null group by 1, 2, 3""",
}


def needed(sql: str) -> list[str]:
    """Views used by a statement, in definition order."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bv_[a-z0-9]+\b", text)) & set(VIEWS):
            if name not in used:
                used.add(name)
                visit(VIEWS[name])

    visit(sql)
    return [n for n in VIEWS if n in used]


def compose(sql: str, doubles: list[str]) -> str:
    """A full statement: views as CTEs, the body, doubles settled at six decimals."""
    names = needed(sql)
    head = "with " + ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in names) + "\n" if names else ""
    if not doubles:
        return f"{head}select * from ({sql})"
    swap = ", ".join(f"{fix(d, 6)} as {d}" for d in doubles)
    return f"{head}select * replace ({swap}) from ({sql})"
