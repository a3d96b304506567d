"""A slow, independent search for stops: tries every ping as the seed of a place."""

import numpy as np

R = 6371000.0


def hav(la, lo, a, o):
    la, lo, a, o = map(np.radians, (la, lo, a, o))
    return 2 * R * np.arcsin(np.sqrt(np.minimum(1, np.sin((a - la) / 2) ** 2 + np.cos(la) * np.cos(a) * np.sin((o - lo) / 2) ** 2)))


def run_around(inside, i, strays):
    """First and last inside index of the run through i with at most so many outs in a row."""
    ix = np.flatnonzero(inside)
    cuts = np.flatnonzero(np.diff(ix) - 1 > strays)
    starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(ix) - 1]
    for s, e in zip(starts, ends):
        if ix[s] <= i <= ix[e]:
            return ix[s], ix[e]
    return None


def session_stops(us, lat, lon, good, radius=100.0, least=360, strays=2):
    found = {}
    for i in np.flatnonzero(good):
        a, o, run = lat[i], lon[i], None
        for _ in range(4):
            inside = good & (hav(lat, lon, a, o) <= radius)
            new = run_around(inside, i, strays)
            if new is None:
                run = None
                break
            ix = np.arange(new[0], new[1] + 1)
            ix = ix[inside[ix]]
            a, o = np.median(lat[ix]), np.median(lon[ix])
            if new == run:
                break
            run = new
        if run and us[run[1]] - us[run[0]] >= least * 1e6:
            found[run] = us[run[1]] - us[run[0]]
    out, taken = [], np.zeros(len(us), bool)
    for (s, e), _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if not taken[s : e + 1].any():
            taken[s : e + 1] = True
            out.append((int(us[s] // 1_000_000), int(us[e] // 1_000_000)))
    return sorted(out)


def all_stops(pdf, silence=1800):
    """pdf: driver_id, latitude, longitude, us."""
    rows = []
    pdf = pdf.drop_duplicates(["driver_id", "us", "latitude", "longitude"]).sort_values(["driver_id", "us", "latitude", "longitude"])
    for d, g in pdf.groupby("driver_id"):
        us, lat, lon = g.us.to_numpy(), g.latitude.to_numpy(), g.longitude.to_numpy()
        good = ~((lat == 0) & (lon == 0)) & (np.abs(lat) <= 90) & (np.abs(lon) <= 180)
        for part in np.split(np.arange(len(us)), np.flatnonzero(np.diff(us) > silence * 1e6) + 1):
            rows += [(d, s, e) for s, e in session_stops(us[part], lat[part], lon[part], good[part])]
    return rows
