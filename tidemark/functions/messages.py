"""Message templates of the insight, risk and recommendation tables.

Fixed values: the texts are part of the result contract.  Names in braces are filled from columns.
"""

# ---- insights --------------------------------------------------------------------------
REVENUE_TREND_TITLE = "Revenue trending {direction} {pct}% week-over-week"
REVENUE_TREND_TEXT = (
    "The last {days} days generated ${recent} in P50 revenue, compared with ${prior} in the prior "
    "{days}-day period — a change of {change}%."
)
PLATFORM_SHARE_TITLE = "{platform} {direction} share ({delta}pp)"
PLATFORM_SHARE_TEXT = (
    "{platform} now accounts for {share}% of forecast revenue (${recent}), versus {prior_share}% "
    "(${prior}) last period."
)
CONFIDENCE_TITLE = "Forecast confidence interval is wide ({width}%)"
CONFIDENCE_TEXT = (
    "The P10/P90 interval spans ${p10} to ${p90} around a P50 of ${p50} — a range of {width}% of "
    "P50. Interpret point forecasts with caution."
)
SPEND_MOMENTUM_TITLE = "{platform} spend {direction} ({change}%)"
SPEND_MOMENTUM_TEXT = (
    "{platform} spend over the last {days} days was ${recent}, {change}% vs prior period (${prior})."
)
HOLIDAY_TITLE = "Elevated holiday intensity detected (score={score})"
HOLIDAY_TEXT = (
    "The average holiday intensity score over the last 7 days is {score} (scale 0–1), indicating "
    "seasonal demand uplift. Forecasts may underestimate peak revenue if not extrapolating this "
    "signal."
)
TOP_CAMPAIGN_TITLE = "Top contributor: {id} ({share}% of revenue)"
TOP_CAMPAIGN_TEXT = (
    "Campaign '{id}' generated ${revenue} in P50 forecast revenue over the last {days} days, "
    "representing {share}% of total."
)

# ---- risks -----------------------------------------------------------------------------
UTILIZATION_TITLE = "{platform} · {id}: budget utilisation {util}"
UTILIZATION_TEXT = (
    "Campaign '{id}' ({raw_platform}) spent only {util} of its daily budget on average over the "
    "last {days} days. Threshold: {threshold}. Increasing budget further is unlikely to improve "
    "revenue."
)
UTILIZATION_CRITICAL_ADVICE = (
    "Budget for campaign '{id}' appears over-allocated. Reallocate surplus to campaigns with "
    "higher utilisation."
)
UTILIZATION_HIGH_ADVICE = (
    "Review budget cap for campaign '{id}'. Either the budget is too high or bids are too low to "
    "clear it."
)
SATURATION_TITLE = "{platform} · {id}: saturation {sat}"
SATURATION_TEXT = (
    "Campaign '{id}' ({raw_platform}) is at {sat} saturation (Hill curve saturation score). "
    "Marginal ROAS at current spend ${spend}/day = ${mroas}x, well below average ROAS of ${roas}x."
)
SATURATION_CRITICAL_ADVICE = (
    "Campaign '{id}' is effectively saturated. Further spend increases will yield negligible "
    "revenue gains. Reallocate budget to lower-saturation campaigns."
)
SATURATION_HIGH_ADVICE = (
    "Campaign '{id}' is approaching saturation. Marginal ROAS is ${mroas} vs average ROAS ${roas}."
)
CI_RISK_TITLE = "{platform} · {id}: low forecast confidence ({width} CI width)"
CI_RISK_TEXT = (
    "Campaign '{id}' has a P10–P90 interval of ${p10}–${p90} around P50=${p50} (width={width} of "
    "P50). Threshold: {threshold}. Decisions relying on this campaign's forecast carry higher "
    "uncertainty."
)
CI_RISK_ADVICE = "Avoid large budget commitments for this campaign until confidence improves."
ZERO_REVENUE_TITLE = "{platform} · {id}: {share} zero-revenue days"
ZERO_REVENUE_TEXT = (
    "Campaign '{id}' ({raw_platform}) had {share} of its spending days yield zero attributed "
    "revenue over the last {days} days. Attribution may be broken, or conversion tracking is "
    "missing."
)
ZERO_REVENUE_ADVICE = (
    "Audit conversion tracking for this campaign. If tracking is correct, consider pausing or "
    "restructuring."
)
CONCENTRATION_TITLE = "{platform} receives {share} of total spend"
CONCENTRATION_TEXT = (
    "{platform} accounts for ${spend}/day out of ${total}/day total ({share}). High concentration "
    "creates single-point-of-failure risk if platform performance declines."
)
CONCENTRATION_ADVICE = (
    "Diversify budget across platforms to reduce dependency on {platform}."
)

# ---- recommendations -------------------------------------------------------------------
INCREASE_TITLE = "Increase {platform} · {id} spend by ${amount}/day (+{pct}%)"
INCREASE_TEXT = (
    "The optimizer projects +${lift}/day (+{lift_pct}%) revenue at marginal ROAS ${mroas}x. "
    "Saturation at optimal spend: {sat}."
)
DECREASE_TITLE = "Reduce {platform} · {id} spend by ${amount}/day ({pct}%)"
DECREASE_TEXT = (
    "Campaign is {state} at current spend. Reducing by ${amount}/day frees budget for "
    "higher-return campaigns. Revenue impact: {lift_pct}%/day."
)
MOVE_TITLE = "Move ${amount}/day from {source} → {target}"
MOVE_TEXT = (
    "Marginal ROAS differential: {target} earns ${target_mroas}x vs {source} earns "
    "${source_mroas}x. Moving ${amount}/day is projected to lift daily revenue by ${lift}."
)
BOOST_TITLE = "Boost {platform} · {id} by ${amount}/day (+15%)"
BOOST_TEXT = (
    "Highest marginal ROAS in portfolio: ${mroas}x. Saturation at {sat} — still room to grow. "
    "Projected daily revenue lift: +${lift}."
)
TRIM_TITLE = "Reduce {platform} · {id} by ${amount}/day (-15%)"
TRIM_TEXT = (
    "Lowest marginal ROAS in portfolio: ${mroas}x. Saturation at {sat}. Revenue impact of cut: "
    "${lift}/day."
)
