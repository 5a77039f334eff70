"""The policy row by row, and random scored windows, for the tests of the batch and the stream."""

SCORED = ("match_id bigint, row_no bigint, time_s double, now_s double, period int, team string, probability double, window_valid boolean, "
          "invalid_reason string, is_dead_ball double, ball_in_box double, recent_box_entry_count double, possession_duration_s double, "
          "attackers_ahead_of_ball double, nearest_defender_dist double, defensive_line_x double, space_ahead_of_ball double")


def scored_rows(r, n):
    t, rows = 0.0, []
    for i in range(n):
        t = round(t + r.choice([0.04, 0.5, 3.0]), 2)
        u = r.random()
        rows.append((1, i + 1, t, t + r.choice([0.0, 0.0, 3.0]), 1, "home", r.choice([0.2, 0.7, 0.95]), u > 0.05,
                     None if u > 0.05 else r.choice(["insufficient_frames", "invalid_window"]), float(r.random() < 0.05),
                     float(r.random() < 0.05), r.choice([0.0, 2.0]), r.choice([3.0, 9.0]), 3.0, 6.0, 0.0, 0.0))
    return rows


def policy_loop(rows, late, threshold=0.5):
    streak, last, out = 0, {}, []
    band = threshold + (1 - threshold) * 0.45
    for x in rows:
        now = x[3] if late else x[2]
        kind = "sustained_pressure" if x[11] >= 2 and x[12] >= 8 else "elevated_entry_chance" if x[6] >= band else "building_threat"
        reason = None
        if not x[7]:
            reason = "insufficient_frames" if x[8] == "insufficient_frames" else "invalid_window"
        elif x[9] > 0.5:
            reason = "dead_ball"
        elif x[10] > 0.5:
            reason = "already_in_box"
        elif x[6] < threshold:
            reason = "low_confidence"
        if reason:
            streak = 0
        else:
            streak += 1
            if streak < 2:
                reason = "not_yet_sustained"
            elif now - x[2] > 2:
                reason, streak = "stale_situation", 0
            elif kind in last and now - last[kind] < 20:
                reason = "cooldown"
            elif kind in last and now - last[kind] <= 45:
                reason = "duplicate_recent"
            else:
                last[kind] = now
        out.append(reason)
    return out
